"""The languages found by one stage of the pipeline decide what the mix takes."""

import random
from collections import Counter

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rare_languages_of_a_source_are_taken_twice(spark, sf_dir):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(k, text(k), "b" if k % 10 == 0 else "a", "s", 0) for k in range(100)] + [(200 + k, text(k), None, None, 0) for k in range(4)]
    often = Counter(r["doc_id"] for r in C.mixed(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect())
    rare = [often[k] for k in range(0, 100, 10)]
    assert rare == [2] * 10 and max(often.values()) == 2 and abs(sum(often.values()) - 1.5 * 104) <= 2
    alike = Counter(r["doc_id"] for r in C.mixed(spark, spark.createDataFrame([(*r[:2], "a", *r[3:]) for r in rows], SCHEMA), sf_dir).collect())
    assert alike != often and abs(sum(alike[k] for k in range(100)) - sum(often[k] for k in range(100))) <= 1


def test_the_language_stage_passes_on_what_it_found(spark, sf_dir):
    rng = random.Random(7)
    parts = {"a": ("the", "ing", "tion", "and"), "b": ("\u00f1e", "que", "ci\u00f3", "los")}
    words = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(60))
    rows = [(k, words("ab"[k % 2]), None if k % 15 == 0 else "ab"[k % 2], "s", 0) for k in range(150)]
    got = {r["doc_id"]: r["lang"] for r in C.language(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()}
    assert sum(got[k] == "ab"[k % 2] for k in range(150)) >= 148 and all(got[k] for k in range(0, 150, 15))
