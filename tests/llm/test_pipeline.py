"""The pipeline, stage by stage, on small tables."""

import random

import corpus_pipeline as C
from ridgeline.llm import language_id, packing, quality_rules
from ridgeline.llm.shared import Workspace


def _docs(spark):
    rng = random.Random(2)
    parts = {"a": ("the", "ing", "tion", "and"), "b": ("ñe", "que", "ció", "los")}
    rows = []
    for k in range(120):
        lang = rng.choice("ab")
        text = "\n".join(" ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(12)) for _ in range(8))
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    for k in range(20):  # near copies, an exact copy under another id, and exact repeats of rows
        changed = rows[k][1].replace("\n", " extra\n", 1)
        rows.append((500 + k, changed, rows[k][2], "s0", len(changed)))
    rows.append((600, rows[40][1], rows[40][2], "s1", rows[40][4]))
    rows += [rows[50], rows[50]]
    rows += [(700, None, None, None, None), (701, "", "a", "s1", 0), (702, "short", "a", "s1", 5), (703, "12 34 " * 100, "a", "s2", 600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, sf_dir):
    docs, work = _docs(spark), Workspace(spark, "test")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(C.STAGES):
        docs = work.put(str(k), stage(spark, docs, sf_dir))
        seen.append(docs.collect())
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns, name
    first = {r["doc_id"] for r in seen[0]}
    assert first == {r["doc_id"] for r in quality_rules.judge(_docs(spark)).filter("kept").collect()} and not first & {700, 701, 702, 703}
    assert {r["doc_id"] for r in seen[1]} >= first - {703}
    ids = [r["doc_id"] for r in seen[2]]
    assert len(ids) == len(set(ids)) and set(ids) == set(range(120))
    copies = [r["doc_id"] for r in seen[3]]
    assert set(copies) <= set(ids) and max(copies.count(d) for d in ids) <= 2 and 1.3 < len(copies) / len(ids) < 1.7
    assert {r["doc_id"] for r in seen[4]} == set(copies)
    total = sum(r["length"] for r in seen[4])
    assert total == sum(r["length"] for r in packing.pack(spark.createDataFrame(seen[3], docs_schema(columns))).collect())


def docs_schema(columns):
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_nothing(spark, sf_dir):
    docs, work = _docs(spark).limit(0), Workspace(spark, "none")
    for k, (_, stage) in enumerate(C.STAGES):
        docs = work.put(str(k), stage(spark, docs, sf_dir))
        assert docs.count() == 0


def test_quality_stage_passes_on_the_cleaned_text(spark, sf_dir):
    rows = [(k, "Banner of the host\n" + (body := " ".join(f"w{k}x{j}" for j in range(60))), "a", "s0", 0, body) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, body string")
    got = C.quality(spark, docs, sf_dir).collect()
    assert len(got) == 12 and all(r["text"].endswith(r["body"]) and r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"] == r["body"] for r in got) == 11 and sum(r["text"] == "Banner of the host\n" + r["body"] for r in got) == 1


def test_language_stage_keeps_mixed_documents(spark, sf_dir):
    rng = random.Random(4)
    parts = {"a": ("the", "ing", "tion", "and"), "b": ("ñe", "que", "ció", "los"), "c": ("sch", "ung", "ß", "der")}
    words = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, words(lang, 60), lang, "s", 0) for k in range(150) for lang in [rng.choice("abc")]]
    rows += [(500 + k, "\n".join(words(lang, 40) for lang in "abc"), "a", "s", 0) for k in range(10)] + [(600, "12 34", "a", "s", 0)]
    got = {r["doc_id"] for r in C.language(spark, spark.createDataFrame(rows, docs_schema(None)), sf_dir).collect()}
    assert got == {r[0] for r in rows} - {600}


def test_every_label_is_sampled(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k % 70}") for k in range(140)], "doc_id long, text string, lang string")
    samples = language_id.training_samples(docs, "text", "lang", docs["doc_id"] >= 0, "doc_id", 1, 100)
    assert len(samples) == 70 and len(set(label for _, label in samples)) == 70
