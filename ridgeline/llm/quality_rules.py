"""Quality rules: statistics of a document's own text, and the frequency of its lines across documents of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import Workspace

#: Fixed values of the word pattern, its white space, and the counted symbols.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of more distinct documents of a host than this is frequent. Lines of near copies stand in fewer documents.
LEAST_DOCS = 10
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


_GAP, _SPACES = _sql_text(WORD_GAP), _sql_text(SPACES)


def _words(text: str) -> str:
    return f"filter(split({text}, {_GAP}), x -> x != '')"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to a value that is computed once, however the optimiser moves the whole."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(text: str) -> str:
    """SQL for the words that lie in a window of three that the text holds at least twice.

    Hashed windows are sorted, equal neighbours give the repeated hashes, and the places that hold one are walked in
    order, each adding the words that the one before hasn't covered. Where many hashes repeat, places are found by
    sorting (hash, place) pairs instead of by searching, so no text costs more than a sort.
    """
    hashes = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(1, size(w) - 2), i -> xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2))))"
    ordered = "if(size(array_distinct(h)) = size(h), cast(array() as array<bigint>), sort_array(h))"
    repeated = "array_distinct(filter(s, (x, i) -> i > 0 and x = element_at(s, i)))"
    same = "(k > 0 and e.x = element_at(a, greatest(k, 1)).x) or (k + 1 < size(a) and e.x = element_at(a, least(k + 2, size(a))).x)"
    by_sort = _let("a", "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))", f"transform(filter(transform(a, (e, k) -> struct(e.i as i, {same} as twice)), e -> e.twice), e -> e.i)")
    places = f"case when size(d) = 0 then cast(array() as array<int>) when size(d) <= 64 then filter(transform(h, (x, i) -> if(array_contains(d, x), i, -1)), i -> i >= 0) else sort_array({by_sort}) end"
    covered = f"aggregate({places}, struct(-3 as last, 0L as total), (a, p) -> struct(p as last, a.total + least(3, p - a.last) as total), a -> a.total)"
    return _let("w", _words(text), _let("h", hashes, _let("s", ordered, _let("d", repeated, covered))))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; row by row, no shuffle.

    Null text has no words. Clashing columns of the docs are replaced.
    """
    text = f"coalesce(`{text_col}`, '')"
    own = [c for c in docs.columns if c not in (*STATISTICS, "base_failed")]
    lines = _let("l", f"filter(split({text}, '\\n'), x -> translate(x, {_SPACES}, '') != '')", "cast(size(l) - size(array_distinct(l)) as bigint)")
    rated = docs.select(
        *own,
        F.expr(f"cast(regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+') as bigint)").alias("n_words"),
        F.expr(f"cast(length(translate({text}, {_SPACES}, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(length({text}) - length(translate({text}, '{SYMBOLS}', '')) as bigint)").alias("n_symbols"),
        F.expr(lines).alias("n_dup_lines"),
        F.expr(_repeat_words(text)).alias("n_repeat_words"),
    )
    return rated.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _key(text_col: str) -> Column:
    """A text's key: the first 60 bits of its MD5, which SQL engines have alike."""
    return F.expr(f"cast(conv(substring(md5(`{text_col}`), 1, 15), 16, 10) as bigint)")


def _normal(line: str) -> str:
    """SQL for a line in lower case, its white space as single spaces; empty if it has no word."""
    return f"trim(BOTH ' ' FROM translate(regexp_replace({line}, {_GAP}, ' '), '{UPPER}', '{LOWER}'))"


def _line_words(normal: str) -> str:
    return f"length({normal}) - length(replace({normal}, ' ', '')) + 1"


def _lines(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """host, text key, the text's words, hash and words of every line that has a word."""
    # what is of the whole text is computed below the explode, once a text
    whole = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(host_col).alias("host"), _key(text_col).alias("t"), F.expr(f"regexp_count(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+')").alias("words"), F.split(text_col, "\n").alias("lines")
    )
    split = whole.select("host", "t", "words", F.posexplode("lines").alias("pos", "line"))
    return split.select("host", "t", "words", "pos", F.expr(_normal("line")).alias("line")).filter("line != ''").select("host", "t", "words", "pos", F.xxhash64("line").alias("h"), F.expr(_line_words("line")).alias("w"))


def _frequent(lines: DataFrame, least_docs: int, salts: int) -> DataFrame:
    seen = lines.select("host", "h", "t", F.pmod("t", F.lit(salts)).cast("tinyint").alias("salt"))
    salted = seen.groupBy("host", "h", "salt").agg(F.count_distinct("t").alias("n"), F.min("t").alias("first"))
    counts = salted.groupBy("host", "h").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return counts.filter(F.col("n") > least_docs).select("host", "h", "first")


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, salts: int = 16) -> DataFrame:
    """host, h, first: hashes of normalised lines in more than `least_docs` distinct documents of a host, whatever its size.

    `first` is the least key of the texts that hold the line: that text keeps it, so of near copies one stays whole.
    Documents with equal texts count once. Distinct texts are counted within salts of the text's hash, so a line that
    a third of all documents hold is counted by many tasks; the counts of the salts are then added.
    """
    return _frequent(_lines(docs, host_col, text_col), least_docs, salts)


def _counted(table: DataFrame, small: int) -> DataFrame:
    """The stored table, to be broadcast if it has up to `small` rows."""
    return F.broadcast(table) if table.count() <= small else table


def _hits(docs: DataFrame, host_col: str, text_col: str, least_docs: int, small: int) -> DataFrame:
    """host, t, words, pos, w: the places of frequent lines in each distinct text of a host but the line's first, and their words.

    The texts are split once: hashes and word counts of their lines are kept in the shared folder.
    """
    work = Workspace(docs.sparkSession, "quality")
    lines = work.put("lines", _lines(docs, host_col, text_col))
    frequent = _counted(work.put("frequent", _frequent(lines, least_docs, 16)), small)
    hit = lines.alias("l").join(frequent.alias("f"), F.expr("l.h = f.h and l.host <=> f.host and l.t <> f.first")).select("l.host", "l.t", "l.words", "l.pos", "l.w")
    return hit.dropDuplicates(["host", "t", "pos"])


def depleted_texts(docs: DataFrame, host_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, gone: float = 0.7, small: int = 500_000) -> DataFrame:
    """host, t: texts that lose at least `gone` of their words with the frequent lines of their host; one row each."""
    removed = _hits(docs, host_col, text_col, least_docs, small).groupBy("host", "t").agg(F.sum("w").alias("removed"), F.max("words").alias("words"))
    return removed.filter(F.col("removed") >= gone * F.col("words")).select("host", "t")


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, gone: float = 0.7, small: int = 500_000) -> DataFrame:
    """The docs with the statistics, base_failed and kept.

    A document is kept unless its base rules fail or it is depleted: at least `gone` of its words are in lines that more
    than `least_docs` distinct documents of its host hold. The first of those, by the text's key, keeps the line: so a
    group of near copies that share most lines loses all but one, not its original, too. A null host is a host of its own. A null text
    has no words, so its base fails. Repeated rows are judged each, and alike. Clashing columns of the docs are replaced.

    Frequent lines and depleted texts are written to the shared folder and counted: up to `small` (16 bytes each) they
    are broadcast, so texts stay where they are; more are joined by a shuffle.
    """
    depleted = Workspace(docs.sparkSession, "quality").put("depleted", depleted_texts(docs, host_col, text_col, least_docs, gone, small).select("host", "t", F.lit(True).alias("_depleted")))
    depleted = _counted(depleted, small)
    rated = with_statistics(docs, text_col)
    rated = rated.select(*[c for c in rated.columns if c != "kept"], _key(text_col).alias("_t"))
    joined = rated.alias("d").join(depleted.alias("x"), F.expr(f"d._t = x.t and d.`{host_col}` <=> x.host"), "left")
    return joined.select("d.*", F.expr("not base_failed and x._depleted is null").alias("kept")).drop("_t")


def _taken(sorted_hashes: str, firsts: str, h: str, t: str, most: int) -> str:
    """SQL for whether a sorted array of up to `most` hashes holds one, found by halving, and another text than t is its first."""
    halves = ", ".join(str(1 << k) for k in reversed(range(most.bit_length())))
    at = f"aggregate(array({halves}), 0, (at, step) -> if(get({sorted_hashes}, at + step - 1) <= q, at + step, at))"
    return _let("q", h, _let("p", at, f"coalesce(get({sorted_hashes}, p - 1) = q and get({firsts}, p - 1) <> {t}, false)"))


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, gone: float = 0.7, small: int = 500_000) -> DataFrame:
    """The rows of `judge`, with the frequent lines of their host removed from the text and the others joined again.

    The statistics and base_failed are of the text as it came; texts without a frequent line stay as they are. The frequent
    lines are stored and counted: up to `small`, each host's sorted hashes and firsts (16 bytes a line) are broadcast, and texts are cut
    where they are. Of more, the places of the removed lines are joined to the texts by a shuffle.
    """
    work = Workspace(docs.sparkSession, "quality")
    frequent = work.put("frequent", frequent_lines(docs, host_col, text_col, least_docs))
    n = frequent.count()
    rated = with_statistics(docs, text_col)
    own = [c for c in rated.columns if c != "kept"]
    if n <= small:
        pairs = frequent.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("h", "first"))).alias("p"))
        hosts = F.broadcast(pairs.select("host", F.col("p.h").alias("hs"), F.col("p.first").alias("fs")))
        joined = rated.select(*own, _key(text_col).alias("_t")).alias("d").join(hosts.alias("x"), F.expr(f"d.`{host_col}` <=> x.host"), "left")
        line = _let("n", _normal("l"), f"struct(l as l, if(n != '' and {_taken('x.hs', 'x.fs', 'xxhash64(n)', 'd._t', max(1, n))}, {_line_words('n')}, 0) as w)")
        each = _let("e", f"transform(split(d.`{text_col}`, '\\n'), l -> {line})", f"struct(aggregate(e, 0, (a, y) -> a + y.w) as removed, if(exists(e, y -> y.w > 0), array_join(transform(filter(e, y -> y.w = 0), y -> y.l), '\\n'), d.`{text_col}`) as text)")
        # an explode of one, so that neither part of it is computed again for a filter
        cut = joined.select("d.*", F.explode(F.expr(f"array(if(x.hs is null or d.`{text_col}` is null, struct(0 as removed, d.`{text_col}` as text), {each}))")).alias("_cut"))
        kept = F.expr(f"not base_failed and (_cut.removed = 0 or _cut.removed < {gone}D * n_words)").alias("kept")
        return cut.select(*[F.col("_cut.text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in own], kept)
    cuts = work.put("cuts", _hits(docs, host_col, text_col, least_docs, small).groupBy("host", "t").agg(F.sum("w").alias("removed"), F.collect_list("pos").alias("cut")))
    joined = rated.select(*own, _key(text_col).alias("_t")).alias("d").join(cuts.alias("x"), F.expr(f"d._t = x.t and d.`{host_col}` <=> x.host"), "left")
    left = _let("l", f"split(d.`{text_col}`, '\\n')", "array_join(transform(array_except(sequence(0, size(l) - 1), x.cut), i -> element_at(l, i + 1)), '\\n')")
    text = F.expr(f"if(x.cut is null, d.`{text_col}`, {left})").alias(text_col)
    kept = F.expr(f"not base_failed and coalesce(x.removed < {gone}D * n_words, true)").alias("kept")
    return joined.select(*[text if c == text_col else F.col(f"d.`{c}`") for c in own], kept)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, text IS NULL AS missing FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
raw AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE NOT missing),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
ln AS (SELECT rid, source, text, trim(translate(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS line FROM raw),
freq AS (SELECT source, line, min(substr(md5(text), 1, 15)) AS first FROM ln WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT text) > 10),
gone AS (SELECT rid, sum(length(ln.line) - length(replace(ln.line, ' ', '')) + 1) AS n FROM ln JOIN freq f ON ln.line = f.line AND ln.source IS NOT DISTINCT FROM f.source AND substr(md5(ln.text), 1, 15) <> f.first GROUP BY rid),
s AS (SELECT d.rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS removed
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed > 0 AND removed >= 0.7 * n_words) AS kept FROM b
"""
