"""The ten operators against brute force, on texts with nulls, repeats, ties, odd sizes and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import hashlib
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ridgeline.llm import fingerprints, html_extraction, language_id, lm_scoring, ngram_join, packing, quality_rules, source_mix, token_counts, url_filters
from ridgeline.llm.shared import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, block int, host string, n_words string, bucket int, key string"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(FOLD))


def raw_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def odd_texts():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mi", "nü", "pé", "zu") for b in ("r", "st", "en", "é", "###", "")]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 140))) for _ in range(40)]
    lines = ["\n".join(p[k : k + 50] for k in range(0, len(p), 50)) for p in prose[:15]]
    return [
        None, "", " ", " \n\t\n ", "one", "One  two", "a b c", "a b c a b c", "x" * 3000, " ".join(["same line here\n"] * 60), "漢字 かな\u3000全角  空白\u00a0x", "emoji 🙂🙂 end", "<|endoftext|> in <s> text </s>", "tab\tand\r\nline\x0bfeed\x0c",
        " lead and trail ", "▁mark ▁ here  two", *prose, *lines, " ".join(prose), "don't we'll I'm 123 45,6", *prose[:3], prose[0] + " more", "Licence line.\n" + lines[0],
    ]


def odd_docs(spark):
    texts = odd_texts()
    rows = [(k * 3, t, None if k % 9 == 0 else "ab"[k % 2], None if k % 7 == 0 else f"s{k % 3}", 0, "i", "s", 1, "h", "w", 5, "k") for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "null id text with words", "a", "s1", 1, "i", "s", 1, "h", "w", 5, "k"), (7, "tie", "a", "s1", 1, None, None, None, None, None, None, None), (7, "tie other", "b", "s1", 1, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def local_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def sorted_rows(rows):
    return sorted(rows, key=repr)


def duck(docs, sql):
    con = duckdb.connect()
    pdf = pd.DataFrame([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con.register("raw", pdf)
    con.execute("create view documents as select cast(doc_id as bigint) as doc_id, cast(text as varchar) as text, cast(source as varchar) as source from raw")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


# 1


def test_html_keeps_the_article_only():
    page = """<html><head><title>No</title><style>p{}</style></head><body><header>Site head</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use <div>cookies</div></div><article class='post'><h1>Head &amp; line</h1><p>First   para<b>graph</b> &lt;ok&gt;<p>Second <a href="a>b">link</a>.
    <aside>Aside</aside><div class="ad">Buy</div><script>var t="</p><p>no";</script><!-- <p>no</p> --><p>Es.</p><form><input><p>Form</p></form></article>
    <section id="comments"><p>Reader says a lot of words here, quite a lot of words.</p></section><footer>&copy; foot</footer>"""
    assert html_extraction.main_text(page) == "Head & line\nFirst paragraph <ok>\nSecond link.\nEs."


def test_html_without_article_finds_the_dense_lines():
    menu = "".join(f"<div><a href='/{k}'>item {k}</a></div>" for k in range(12))
    body = "".join(f"<p>Sentence number {k} with enough words to be read.</p>" for k in range(6))
    got = html_extraction.main_text(f"<body>{menu}{'<div></div>' * 4}<div>{body}</div>{menu}")
    assert got.split("\n")[0].startswith("Sentence number 0") and "item" not in got and len(got.split("\n")) == 6
    assert html_extraction.main_text(None) == html_extraction.main_text("") == html_extraction.main_text("<nav>x</nav>") == ""
    assert html_extraction.main_text("plain words alone, no markup at all") == "plain words alone, no markup at all"
    assert len(html_extraction.main_text("<article>" + "<p>word word</p>" * 20000)) > 100_000


def brute_stretches(kinds, window=3, share=0.25):
    """Texts with fewer than `window` lines of other kinds between them, or none but adverts, form a stretch; those with a share of the longest one stay."""
    runs, between = [], None
    for kind, text in kinds:
        if kind != "text":
            between = None if between is None else [*between, kind]
        else:
            if between is None or (len(between) >= window and "links" in between):
                runs.append([])
            runs[-1].append(text)
            between = []
    longest = max((sum(map(len, r)) for r in runs), default=0)
    return [t for r in runs if sum(map(len, r)) >= share * longest for t in r]


def test_html_reads_names_in_camel_case_and_keeps_short_stretches():
    prose = "A sentence of the article that is long enough to rise above the lines around it."
    for name in ("commentSection", "CommentsArea", "readerResponses", "sidebarLeft", "cookieBar", "HTMLFooter"):
        page = f"<body><article><p>{prose}</p><div class='{name}'><p>{prose} Not this.</p></div><p>{prose} End.</p></article></body>"
        assert html_extraction.main_text(page) == f"{prose}\n{prose} End.", name
        assert html_extraction.main_text(page.replace("article>", "div>")) == f"{prose}\n{prose} End.", name
    assert html_extraction.main_text(f"<article><div class='noSidebar'>{prose}</div><div id='undoHeading'>{prose}</div></article>") == f"{prose}\n{prose}"
    assert html_extraction.main_text(f"<article><p>{prose}</p><div id='responses'>{prose}</div></article>") == prose
    links = "".join(f"<p><a href='/{k}'>A link to page {k}</a></p>" for k in range(8))
    page = f"<body><section>{f'<p>{prose}</p>' * 9}</section><section>{links}</section><section><p>{prose} Closing.</p></section></body>"
    assert html_extraction.main_text(page).split("\n")[-1] == f"{prose} Closing." and "link" not in html_extraction.main_text(page)


def test_html_windows_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        kinds = []
        for k in range(rng.randrange(1, 40)):
            kind = rng.choice(("text", "links", "links", "ad"))
            run = rng.choice((1, 1, 2, 6)) if kind == "links" else 1
            kinds += [(kind, f"{'link' if kind == 'links' else kind} {k} " + "word " * rng.randrange(8, 30) + "end") for _ in range(run)]
        page = "".join(f"<p>{t}</p>" if kind == "text" else f"<p><a href=x>{t}</a></p>" if kind == "links" else f"<div class=ad>{t}</div>" for kind, t in kinds)
        for share in (0.0, 0.25):
            got = html_extraction.main_text(f"<body>{page}</body>", least_share=share)
            assert [t for t in got.split("\n") if t.startswith("text")] == brute_stretches(kinds, share=share)
        assert "ad " not in got or not any(kind == "text" for kind, _ in kinds)


def test_html_reads_broken_tags_and_negated_classes():
    assert html_extraction.main_text('Before <a title="foo>link</a> after words here') == "Before link after words here"
    words = "word " * 50
    for name in ("content no-sidebar", "without-comments", "post not_an-ad"):
        assert html_extraction.main_text(f'<nav>menu</nav><div class="{name}"><p>{words}</p></div>') == words.strip()
    assert html_extraction.main_text(f'<div class="ad-block"><p>{words}</p></div>') == words.strip()  # nothing else has text
    assert html_extraction.main_text(f"<article>A</article><footer>{words * 40}</footer><p>{words * 40}</p>") == "A"


def test_html_over_a_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é x</p></article>", "old"), (1, "u", "<article><p>é x</p></article>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert sorted_rows(html_extraction.extract(df).collect()) == sorted_rows([(1, "u", "é x", 3), (1, "u", "é x", 3), (2, None, "", 0)])
    assert html_extraction.extract(df.limit(0)).count() == 0


# 2


def brute_ppm(rows, held, order, x=lm_scoring.DISCOUNT):
    seqs = [b"".join(w + b" " for w in words(t)) + b"\xff" for _, t in rows]
    levels = [dict() for _ in range(order + 1)]
    for s, h in zip(seqs, held):
        padded = b"\xff" * order + s
        for i in range(order, len(padded) if not h else 0):
            for k in range(order + 1):
                levels[k].setdefault(padded[i - k : i], Counter())[padded[i]] += 1

    def one(context, symbol):
        total, excluded = 0.0, set()
        for k in range(order, -1, -1):
            seen = levels[k].get(context[order - k :])
            if seen is None:
                continue
            n, d = sum(c for s, c in seen.items() if s not in excluded), sum(s not in excluded for s in seen)
            if d == 0:
                continue
            if symbol in seen and symbol not in excluded:
                return total + math.log10((seen[symbol] - x) / n)
            total += math.log10(x * d / n)
            excluded |= set(seen)
        return total - math.log10(max(1, 257 - len(levels[0].get(b"", {}))))

    return [sum(one((b"\xff" * order + s)[i : i + order], s[i]) for i in range(len(s))) for s in seqs]


@pytest.mark.parametrize("nobody, common, block", [(False, 1 << 19, 16 << 20), (False, 300, 2000), (True, 1 << 19, 4000)])
def test_lm_scores_equal_brute_force(docs, monkeypatch, nobody, common, block):
    monkeypatch.setattr(lm_scoring, "COMMON", common)
    monkeypatch.setattr(lm_scoring, "CHUNK", block)
    small = docs.filter("text is null or length(text) < 400")
    rows = local_rows(small)
    fold = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10
    held = [nobody or fold(d) == 0 for d, _ in rows]
    train = F.lit(False) if nobody else language_id.fold_of(small["doc_id"], 10) != 0
    got = lm_scoring.score(small, train, block_bytes=block).collect()
    tokens = [[*words(t), None] for _, t in rows]
    seen = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = []
    for (d, _), ws, h, ppm in zip(rows, tokens, held, brute_ppm(rows, held, 5)):
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want.append((d, not h, len(ws), sum(w in seen for w in ws), n, round(base, 6), round(ppm, 6)))
    assert sorted_rows([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in got]) == sorted_rows(want)


def test_lm_scores_of_nothing(nothing):
    assert lm_scoring.score(nothing, F.lit(True)).count() == 0


# 3


def test_fingerprints_equal_brute_force(docs, nothing, spark):
    plain = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(plain).collect()}
    rows = sorted((d, t or "") for d, t in local_rows(plain))
    by_print = {}
    for k, (d, t) in enumerate(rows):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["edit"] is None) == (t == edited) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_print.setdefault(r["fingerprint"], t) == t
        if r["edit"] is not None:
            assert t[: r["edit"]["start"]] == edited[: r["edit"]["start"]]
    assert len(by_print) == len({t for _, t in rows})
    assert fingerprints.compare_edited(docs).count() == docs.count()
    assert fingerprints.compare_edited(nothing).count() == 0
    assert fingerprints.compare_edited(plain.filter("doc_id = 12")).first()["near_next"] == 1.0


def likeness_of(a, b):
    """By the two strings alone: code points of shared marks at the coarser level, by the larger text's."""
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    step = 1 << max(int(f.split(":")[1]) for f in (a, b))
    left, right = ({m for m in re.findall("." * 8, f.split(":")[2]) if int(m[:6], 16) % step == 0} for f in (a, b))
    size = lambda marks: sum(int(x[6:], 16) for x in marks)
    return size(left & right) / max(size(left), size(right), 1)


def chained(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def stretches(units, roll, reach):
    hashes = [chained(*(u.encode() for u in reversed(units[max(0, i - roll + 1) : i + 1]))) for i in range(len(units))]
    ends = [i + 1 for i in range(len(units)) if i == len(units) - 1 or hashes[i] <= min(hashes[max(0, i - reach) : i + reach + 1])]
    return [units[i:j] for i, j in zip([0, *ends], ends)]


def brute_fingerprint(text):
    """Level and marks of a text."""
    leaves = []
    for p in re.findall("[^\n]*\n|[^\n]+", text):
        found = re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+", p)
        units = [u for w in found for u in ([w] if len(w) <= 32 else ["".join(x) for x in stretches(list(w), 4, 4)])]
        leaves += [(chained(*(u.encode() for u in s)) & ~65535 | min(65535, len("".join(s)))) for s in stretches(units, 1, 1)]
    level = max(0, math.ceil(math.log2(len(leaves) / 512))) if leaves else 0
    seen, marks = Counter(), set()
    for x in leaves:
        h = (chained(x.to_bytes(8, "little", signed=True), seen[x].to_bytes(8, "little")) >> 40) & 0xFFFFFF
        seen[x] += 1
        marks |= {f"{h:06x}{min(255, x & 65535):02x}"} if h % (1 << level) == 0 else set()
    return level, marks


def test_fingerprints_are_those_of_brute_force(spark, docs):
    long = " ".join(random.Random(5).choice(("kar", "Lost", "men", "nü", "zuen")) for _ in range(9000))
    texts = [t or "" for t in odd_texts()] + [long, long + " end", " " * 500 + "x", "a\n\n\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)
    got = {r["k"]: r["f"] for r in fingerprints.with_tree(rows, "text", "tree").select("k", fingerprints.fingerprint("tree").alias("f")).collect()}
    for k, t in enumerate(texts):
        _, level, marks = got[k].split(":")
        assert (int(level), set(re.findall("." * 8, marks))) == brute_fingerprint(t)
        assert len(marks) <= 8 * 700


def test_likeness_is_of_what_texts_share_wherever_it_stands(spark):
    rng = random.Random(8)
    code = "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(4000))
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(6000))
    half = prose[: len(prose) // 2]
    other = " ".join("".join(rng.choice("ijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(6000))
    same = "one and the same line\n" * 60
    pairs = [(code, "x" + code), (code, code[2000:] + code[:2000]), (prose, "four words before it " + prose), (prose, half), (prose, other), (same, same[: len(same) * 3 // 4])]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    both = fingerprints.with_tree(fingerprints.with_tree(rows, "a", "x"), "b", "y").select("k", fingerprints.likeness("x", "y").alias("near"))
    near = [r["near"] for r in both.orderBy("k").collect()]
    assert min(near[:3]) > 0.9 and abs(near[3] - 0.5) < 0.08 and near[4] < 0.02 and abs(near[5] - 0.75) < 0.02, near


def test_likeness_follows_from_the_fingerprints(docs):
    rows = fingerprints.compare_edited(docs).collect()
    of = Counter(r["fingerprint"] for r in rows)
    nearest = sorted((r for r in rows), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r in rows:
        assert math.isclose(r["near_edited"], likeness_of(r["fingerprint"], r["edited_fingerprint"]), abs_tol=1e-12)
        assert any(math.isclose(r["near_next"], likeness_of(r["fingerprint"], f), abs_tol=1e-12) for f in of)
    ids = [r["doc_id"] for r in nearest]
    alone = [k for k in range(1, len(ids) - 1) if ids.count(ids[k]) == ids.count(ids[k + 1]) == 1]
    for k in alone:
        assert math.isclose(nearest[k]["near_next"], likeness_of(nearest[k]["fingerprint"], nearest[k + 1]["fingerprint"]), abs_tol=1e-12)


def test_fingerprint_buckets_follow_far_ids(spark):
    ids = [-(1 << 40), 5, 6, 7, 8, 1 << 50]
    df = spark.createDataFrame([(i, f"text {i} " * 9) for i in ids], "doc_id long, text string")
    got = fingerprints.with_next(df, "doc_id", "text", per_bucket=2).collect()
    assert {r["doc_id"]: r["next_text"] for r in got} == {i: f"text {j} " * 9 for i, j in zip(ids, ids[1:] + ids[:1])}


# 4


def test_url_rules_and_words(spark):
    model = url_filters.fit(spark.createDataFrame([("http://blog.casino-win.example.net/en/1",), ("http://ththa.example.net/fr/2",), (None,)], "url string"))
    assert model.segmenter.split("casinowin") == ["casino", "win"] and model.segmenter.split("dailynews") == ["daily", "news"]
    cases = [
        (1, "http://A.B.COM/en/x?y=/z", "a.b.com", "/en/x", "com/en/", "block"), (2, "https://x.example.com/en/75#t", "x.example.com", "/en/75", "example.com/en/7", "allow"), (3, "ftp://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        (4, "a://xexample.net/de/8", "xexample.net", "/de/8", "net/de/", "allow"), (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"), (7, "http://free-bets.example.net/x", "free-bets.example.net", "/x", None, "block"),
        (8, "http://freebets.example.net", "freebets.example.net", "", None, "block"), (9, "://?q", "", "", None, "allow"), (10, "http://garden.example.org/tea/", "garden.example.org", "/tea/", None, "allow"),
    ]
    df = spark.createDataFrame([(c[0], c[1], "old") for c in cases], "page_id long, url string, verdict string")
    got = url_filters.judge(df, model).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted_rows(got) == sorted_rows([(c[0], *c[2:]) for c in cases])
    assert url_filters.judge(df.limit(0), url_filters.fit(df.limit(0))).count() == 0


# 5


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language_id.ByteGru.fresh(["a", "b", "c"], 4, rng)
    net.inputs, net.recurrent, net.output, net.bias = (p.astype(np.float64) for p in net.parameters())
    codes, target, weight = rng.integers(97, 103, (6, 3)), np.array([0, 1, 2]), np.ones((6, 3))
    grads, _ = net.gradients(codes, target, weight)
    for p, g in zip(net.parameters(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p is net.inputs:
                at = (at[0], at[1], 98)
            keep, sides = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = keep + step
                sides.append(net.gradients(codes, target, weight)[1])
            p[at] = keep
            assert abs((sides[0] - sides[1]) / 2e-3 - g[at]) < 2e-3


def brute_pooled(net, raw, window):
    """Mean label probabilities of a text, cell by cell in plain Python, each window from a zero state in both directions."""
    clip = lambda x, low: max(low, min(1.0, x))
    hidden, total = net.recurrent.shape[2], [0.0] * len(net.labels)
    codes = [b + 32 if 65 <= b <= 90 else b for b in raw]
    for at in range(0, len(codes), window):
        part = codes[at : at + window]
        padded = part + [32] * (window - len(part))  # the last window is filled with spaces
        halves = []
        for way, order in ((0, padded), (1, padded[::-1])):
            state, seen = [0.0] * hidden, []
            for code in order:
                added = [float(x) for x in net.inputs[way][:, code]]
                carried = [sum(float(w) * s for w, s in zip(row, state)) for row in net.recurrent[way]]
                reset, update = ([clip(added[g * hidden + k] + carried[g * hidden + k], 0.0) for k in range(hidden)] for g in (0, 1))
                new = [clip(added[2 * hidden + k] + reset[k] * carried[2 * hidden + k], -1.0) for k in range(hidden)]
                state = [u * s + (1 - u) * n for u, s, n in zip(update, state, new)]
                seen.append(state)
            halves.append(seen if way == 0 else seen[::-1])
        for t in range(len(part)):
            both = halves[0][t] + halves[1][t]
            raw_score = [float(b) + sum(float(w) * x for w, x in zip(row, both)) for row, b in zip(net.output, net.bias)]
            top = max(raw_score)
            e = [math.exp(x - top) for x in raw_score]
            total = [a + x / sum(e) for a, x in zip(total, e)]
    return [x / max(1, len(codes)) for x in total]


def test_pooled_probabilities_equal_brute_force():
    net = language_id.ByteGru.fresh(["a", "b", "c"], 3, np.random.default_rng(1))
    texts = [b"", b"x", "Grüße, 漢字!".encode(), b"Abc " * 20, bytes(range(33, 120)) * 2]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    mean, _ = language_id.pooled(net, data, offsets, window=16, width=5)
    for got, text in zip(mean, texts):
        assert np.allclose(got, brute_pooled(net, text, 16), atol=1e-5)


def test_the_sample_has_the_lowest_hashes(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "hot" if k % 5 else f"l{k % 3}") for k in range(600)], "doc_id long, text string, lang string").repartition(7)
    got = language_id.training_samples(docs, "text", "lang", docs["doc_id"] >= 0, "doc_id", 9, 100)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text", "lang").collect()
    want = [(r["text"], r["lang"]) for lang in ("hot", "l0", "l1", "l2") for r in sorted((r for r in keyed if r["lang"] == lang), key=lambda r: r["k"])[:9]]
    assert sorted(got) == sorted(want)


def test_languages_are_told_apart(spark, docs, nothing):
    rng = random.Random(1)
    parts = {"a": ("the", "ing", "tion", "and"), "b": ("ñe", "que", "ció", "los"), "c": ("sch", "ung", "ß", "der")}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang) for k in range(300) for lang in [rng.choice("abc")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df).filter("held_out").collect()
    assert len(got) > 40 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    odd = language_id.identify(docs)
    assert odd.count() == docs.count() and "n_words" in odd.columns
    for r in odd.collect():
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) and 0 <= r["score"] <= 1
    assert language_id.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    net = language_id.fit(df, F.lit(True))
    spans = language_id.predict(df.limit(3), net, spans_col="spans").collect()
    assert all(r["spans"][-1]["end"] == len(r["text"].encode()) for r in spans)


# 6 and 7


def test_token_counts_equal_whole_encodings(docs, nothing):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(d, len((t or "").encode()), n := len(processor.encode(t or "")), n > 100) for d, t in local_rows(docs)]
    assert sorted_rows(token_counts.count_tokens(docs, limit=100).collect()) == sorted_rows(want)
    long = " ".join(w for _, t in local_rows(docs) for w in (t or "").split(" ")) * 5
    for size in (1, 7, 64, 5000):
        assert token_counts.lengths([long], P.path("piece_bpe_32k.model"), piece_chars=size)[0] == len(processor.encode(long))
    assert token_counts.count_tokens(nothing).count() == 0


@pytest.mark.parametrize("window, most", [(1024, 32), (16, 2)])
def test_packing_gives_every_id_once(docs, nothing, window, most):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = Counter()
    for d, t in local_rows(docs):
        ids[d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    rows = packing.pack(docs, window=window, open_windows=most, min_cut=4).collect()
    by_doc = {}
    for (d, raw), n in ids.items():
        by_doc.setdefault(d, []).append((raw, n))
    covered = Counter()
    for r in rows:
        fits = [raw for raw, _ in by_doc[r["doc_id"]] if len(raw) == 4 * r["doc_tokens"] and zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]]
        assert fits and r["length"] > 0
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
    want = Counter()
    for (d, raw), n in ids.items():
        want[d, len(raw) // 4] += n * len(raw) // 4
    assert covered == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and (at & (at - 1) == 0 or window - at < 4)
    assert packing.pack(nothing).count() == 0


# 8


def brute_components(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    out = []
    for size in (3, 4, 6, 8, 12, 20, 30, 38, 41, 44, 47, 60, 90, 200, 500):
        base = [rng.choice(vocabulary) for _ in range(size)]
        if size in (12, 60, 90):
            base[size // 2 : size // 2] = passage
        for edits in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08):
            copy = list(base)
            for _ in range(round(edits * len(copy)) or (edits > 0 and rng.random() < 0.5)):
                place = rng.randrange(len(copy))
                copy[place : place + rng.choice((0, 1))] = [rng.choice(vocabulary)]
            out.append(" ".join(copy))
        for cut in (1, 2, 5):
            out.append(" ".join(base[cut:]).upper())
    return out


def alike(seed, copies=90):
    """Copies of one text with 0 to 14 edits each: some link, most don't, and all share parts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(170)]
    out = []
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randrange(15)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width, num, den, block", [(4, 85, 100, 1 << 18), (5, 80, 100, 300), (3, 70, 100, 5000)])
def test_components_equal_brute_force(spark, docs, monkeypatch, width, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(1000 + k, t) for k, t in enumerate(near_copies(width) + alike(width))] + local_rows(docs)
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = ngram_join.join(df, width=width, num=num, den=den).collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(brute_components(rows, width, num, den))


def test_components_of_nothing(nothing, spark):
    assert ngram_join.join(nothing).count() == 0
    alone = spark.createDataFrame([(3, None), (2, ""), (1, " ")], "doc_id long, text string")
    assert sorted_rows(map(tuple, ngram_join.join(alone).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


# 9 and 10


def test_mix_equals_sql_and_meets_targets(docs, nothing):
    names, want = duck(docs, source_mix.ORACLE)
    got = source_mix.mix(docs).select(*names)
    close = lambda rows: sorted_rows([tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows])
    assert close(map(tuple, got.collect())) == close(want) == close(map(tuple, source_mix.mix(docs).select(*names).collect()))
    by_source = source_mix.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.expr("taken > 2 * size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) < 12 and not r["over"] for r in by_source)
    total = sum(len(raw_words(t)) for _, t in local_rows(docs))
    assert abs(sum(r["target"] for r in by_source) - 1.5 * total) < 1e-6
    assert source_mix.mix(nothing).count() == 0
    assert abs(source_mix.mix(docs).agg(F.sum("taken")).first()[0] - 1.5 * total) <= 1
    by_source = source_mix.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 1 for r in by_source)


def test_schedule_deals_slots_evenly(spark, docs, monkeypatch):
    """Every slot comes once, ranks run on in each source, and any stretch of slots keeps the shares."""
    monkeypatch.setattr(source_mix, "STRETCH", 100)
    monkeypatch.setattr(source_mix, "RANGE", 2)
    work = Workspace(spark, "test")
    rows = docs.select(F.col("source").alias("src"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("size"))
    targets = source_mix.source_targets(rows.groupBy("src").agg(F.sum("size").alias("words")))
    turns = source_mix.slots_of(targets, work, block=3)
    wanted = {r["no"]: r for r in turns.collect()}
    listed = sorted(source_mix.schedule(turns, work).collect())
    points = sum(r["slots"] for r in wanted.values())
    assert [r["slot"] for r in listed] == list(range(points)) and points > 500
    seen = Counter()
    for r in listed:
        assert r["rank"] == seen[r["no"]]
        seen[r["no"]] += 1
    assert seen == {k: r["slots"] for k, r in wanted.items() if r["slots"]}
    part = Counter(r["no"] for r in listed[200:500])
    assert all(abs(part[k] - 300 * r["slots"] / points) < 5 for k, r in wanted.items())


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_by_blocks_is_where_rows_stand(docs, monkeypatch, block):
    """What slots take in blocks of any size adds up to the words by place alone."""
    monkeypatch.setattr(source_mix, "CELL", 4)
    want = [(r["id"], r["size"], r["of"], r["taken"]) for r in source_mix.placed(docs).collect()]
    got = [(r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in source_mix.mix(docs, block=block).collect()]
    assert Counter(got) == Counter(want)


def test_copies_are_the_rounded_mix(docs, nothing):
    often = Counter(r["doc_id"] for r in source_mix.copies(docs).collect())
    assert source_mix.copies(docs).columns == docs.columns
    want = source_mix.mix(docs).filter("size > 0").selectExpr("doc_id", "cast(round(taken / size) as int) as n").collect()
    twice = Counter(r["doc_id"] for r in want)
    assert {d: n for d, n in often.items() if twice[d] == 1} == {r["doc_id"]: r["n"] for r in want if r["n"] and twice[r["doc_id"]] == 1}
    assert source_mix.copies(nothing).count() == 0


def test_quality_equals_sql(spark, docs, nothing):
    rng = random.Random(5)
    shared = "Shared banner of the host."
    pages = [(5000 + k, shared + "\n" + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((2, 4, 70)))), "x", "hot", 0) for k in range(40)]
    wide = [(6000, " ".join(f"w{k % 300}" for k in range(2000)), "x", "wide", 0), (6001, " ".join(f"w{k}" for k in range(900)) + " w1 w2 w3 w4", "x", "wide", 0)]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(pages + wide, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("kept", F.lit("old"))
    names, want = duck(df, quality_rules.ORACLE)
    got = quality_rules.judge(df).select(*names).collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)
    long_shared = [(7000 + k, "\n".join(f"line {j} of a page that the host puts everywhere" for j in range(20)) + f"\nown {k}", "x", "h", 0) for k in range(60)]
    repeated = spark.createDataFrame(long_shared, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["kept"] for r in quality_rules.judge(repeated).collect()} == {False}
    assert quality_rules.judge(nothing).count() == 0


def test_quality_limit_does_not_grow_with_the_host(spark):
    page = "\n".join(" ".join(f"b{j}x{k}" for k in range(8)) for j in range(9))
    rows = [(k, (page if k < 25 else " ".join(f"v{k}x{j}" for j in range(60))) + f"\nown words {k}", "big") for k in range(300)]
    rows += [(1000 + k, page + f"\nfew {k}", "small") for k in range(10)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(25)) - {min(range(25), key=lambda k: hashlib.md5(rows[k][1].encode()).hexdigest())}


def test_quality_removes_frequent_lines(spark, docs, nothing):
    own = lambda k: " ".join(f"o{k}x{j}" for j in range(60))
    rows = [(k, f"Shared  banner\n\n{own(k)}\n shared banner\t\nlast {k}\n", "hot") for k in range(12)] + [(50, f"Shared banner\n{own(50)}", "cold"), (51, f"Shared banner\n{own(51)}", None)]
    page = "\n".join(" ".join(f"b{j}x{k}" for k in range(8)) for j in range(9))
    rows += [(100 + k, f"{page}\nown {k}", "paged") for k in range(12)] + [(0, rows[0][1], "hot"), (200, None, "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.clean(df).filter("kept").select("doc_id", "text").collect()
    first = lambda host: min((r for r in rows if r[2] == host and r[1]), key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
    banner = first("hot")
    want = [(k, banner[1] if rows[k][1] == banner[1] else f"\n{own(k)}\nlast {k}\n") for k in [0, *range(12)]] + [first("paged")[:2]] + [(k, f"Shared banner\n{own(k)}") for k in (50, 51)]
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)
    same = lambda x, d: sorted_rows(map(tuple, x(d).select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept").collect()))
    assert same(quality_rules.clean, df) == same(quality_rules.judge, df) == same(lambda d: quality_rules.clean(d, small=-1), df)
    assert same(quality_rules.clean, docs) == same(quality_rules.judge, docs)
    assert quality_rules.clean(nothing).count() == 0


def test_mix_gives_small_sources_their_share(spark):
    rows = [(k, "w " * 60_000, "large") for k in range(40)] + [(1000 + k, "w " * n, src) for src, sizes in (("few", (90, 210, 7)), ("one", (1,)), ("some", (900, 1100))) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = source_mix.mix(df, weights=(1,)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert sorted(r["source_size"] for r in got) == [1, 307, 2000, 2_400_000]
    assert all(abs(r["taken"] - r["target"]) <= 0.5 for r in got)


def test_url_split_is_the_cheapest_of_all_splits():
    rng = random.Random(5)
    seg = url_filters.Segmenter(Counter({w: rng.randint(1, 50) for w in ("a", "ab", "abc", "bc", "c", "ca", "cab", "aba", "ccc", "bb")}))

    def cost(part):
        return min(seg.costs.get(part, math.inf), seg.unknown + seg.per_letter * len(part))

    for n in (*range(1, 10), 9, 9, 9):
        run = "".join(rng.choice("abcx") for _ in range(n))
        splits = []
        for mask in range(1 << (n - 1)):
            cuts = [0, *(k for k in range(1, n) if mask >> (k - 1) & 1), n]
            splits.append(sum(cost(run[a:b]) for a, b in zip(cuts, cuts[1:])))
        got = seg.split(run)
        assert "".join(got) == run and math.isclose(sum(map(cost, got)), min(splits))


def test_url_log_odds_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["casino", "win", "garden", "tea", "zorb", "quint", "news", "spam", "ÜBER", "漢字"]
    urls = [f"http://{rng.choice(parts)}{rng.choice(('', '-', '.'))}{rng.choice(parts)}.example/{rng.choice(parts)}/{rng.choice(parts)}{k % 7}" for k in range(200)]
    urls += [urls[0], urls[0], None, "none", "http://" + "x" * 5000 + ".example/" + "ab" * 3000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(3)
    model = url_filters.fit(df)
    split, blocked = model.segmenter.tokens, set(url_filters.BLOCK_WORDS)
    heads = {re.match(r".*?://([^/?#]*)([^?#]*)", u).groups() for u in urls if u and "://" in u}
    b, a = Counter(), Counter()
    for host, path in heads:
        found = set(split(host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path))
        (b if found & blocked else a).update(found)
    words = {*a, *b, *url_filters.BLOCK_WORDS, *url_filters.ALLOW_WORDS}
    b_all, a_all = b + Counter({w: 5 for w in url_filters.BLOCK_WORDS}), a + Counter(url_filters.ALLOW_WORDS)
    for w in words:
        want = math.log((b_all[w] + 0.5) / (sum(b.values()) + 5 * len(url_filters.BLOCK_WORDS) + 0.5 * len(words))) - math.log((a_all[w] + 0.5) / (sum(a.values()) + len(url_filters.ALLOW_WORDS) + 0.5 * len(words)))
        assert math.isclose(model.weights[w], want, rel_tol=1e-9, abs_tol=1e-9), w
    got = url_filters.judge(df, model).collect()
    assert len(got) == len(urls) and all(math.isclose(r["score"], sum(model.weights.get(t, 0.0) for t in r["tokens"]), abs_tol=1e-9) for r in got)
    assert all(r["verdict"] == ("block" if r["score"] > 0 else "allow") for r in got if r["rule"] is None)


def test_url_model_reads_whole_paths_of_all_urls(spark):
    urls = [(f"http://host{k}.example/en/deeper/zorbling{'-viagra' if k % 2 else ''}/{k}",) for k in range(60)]
    urls += [(f"http://h{k}.example/a/quintessentially/{'x' * (k % 3)}{k}",) for k in range(60)] + [("http://zorblingquintessentially.example/",), (None,), ("://",)]
    model = url_filters.fit(spark.createDataFrame(urls, "url string").repartition(3))
    assert model.segmenter.counts["zorbling"] == 60 and model.segmenter.counts["quintessentially"] == 60
    assert model.segmenter.split("zorblingquintessentially") == ["zorbling", "quintessentially"]
    assert model.weights["zorbling"] > model.weights["quintessentially"] and model.weights["viagra"] > 0
    small = url_filters.fit(spark.createDataFrame(urls, "url string"), most=8)
    assert len(small.segmenter.counts) <= 8 + len({*url_filters.BLOCK_WORDS, *url_filters.ALLOW_WORDS})


def test_html_keeps_what_follows_set_aside_elements():
    long, closing = "words of the post " * 100, "closing paragraph of the post " * 4
    gap = "".join(f"<li><a href={k}>link {k}</a></li>" for k in range(6))
    menu = "".join(f"<div><a href=/{k}>item {k}</a></div>" for k in range(9))
    want = f"{long.strip()}\n{closing.strip()}"
    for parted in ("<div class=ad>Buy</div>", "<aside>x</aside><div class=share>y</div>", f"<ul>{gap}</ul>"):
        assert html_extraction.main_text(f"<body>{menu}<div class=post><p>{long}</p>{parted}<p>{closing}</p></div>{menu}") == want
    assert html_extraction.main_text(f"<div><p>{long}</p></div>{menu}<div>{closing}</div>", least_share=0.25) == long.strip()
    assert html_extraction.main_text(f"<div><p>{long}</p></div>{menu}<div>{closing}</div>") == want
    links = "".join(f"<p><a href={k}>link {k}</a></p>" for k in range(5))
    assert html_extraction.main_text(f"<article><p>Text.</p>{links}</article><p>no</p>") == "Text.\n" + "\n".join(f"link {k}" for k in range(5))
    assert html_extraction.main_text(f"<body><p class=notice>Note<p>{long}<div>{closing}</div>") == want
    assert html_extraction.main_text(f"<ul><li class=ad>Ad<ul><li>in ad</ul><li>{long}</ul><p>{closing}") == want
    assert html_extraction.main_text(f"<div><div class=x><span class=ad>Ad<p>in ad</p></div><p>{long}</p></div>") == long.strip()
    assert html_extraction.main_text(f"<div><div class=ad>Ad</p><div>in</div>ad</div><p>{long}</p></div>") == long.strip()
