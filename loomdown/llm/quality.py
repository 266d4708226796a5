"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and of common words is compared with a reference of its language by
Jensen-Shannon distance. The references come from all rows of the input: a language with at least `least_words` words has
its own, however small its share of the input. A common word is one that makes up at least `common_share` of its
reference's words, so that a reference holds at most 1 / common_share words. Rows of a null or a still smaller language
are not judged by words, as nothing says which words they should hold; their characters are judged against those of all
rows, with letters of every script in one class.

Defined cases: a null or empty text has no words and fails the base rules. Texts under `min_chars` characters are not
judged by characters, texts under `min_words` words not by words; very long texts are read whole. Repeated rows are judged alike, each on its own;
an empty table gives an empty result; extra columns, also of our names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, GAP, let, written

SYMBOLS = "#*$%&|<>"
CLASSES = ("blank", "upper", "digit", "wide", "stop", "symbol", "rest")


def words_of(text: Column) -> Column:
    core = F.btrim(text, F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP))


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words that lie in a window of `width` words found twice or more in the text."""

    def covered(grams: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            same = lambda i, p: F.coalesce(F.get(pairs, i)["h"] == p["h"], F.lit(False))
            twice = F.filter(pairs, lambda p, i: F.when(i > 0, same(i - 1, p)).otherwise(F.lit(False)) | same(i + 1, p))
            starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
                lambda acc, s: F.struct((acc["n"] + F.least(F.lit(width), s - acc["last"])).alias("n"), s.alias("last")),
                lambda acc: acc["n"],
            )

        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, of_sorted))

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(let(hashed, windows), covered)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def half_term(p: Column, q: Column) -> Column:
    """The share of the divergence, in bits, of a cell with probabilities p and q."""
    one = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(F.lit(0.0))
    return (one(p) + one(q)) / 2


def base_columns(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The row as `row`, with its words and the counts that need no reference."""
    t = F.coalesce(F.col("row")[text], F.lit(""))
    df = docs.select(F.struct("*").alias("row")).select("row", t.alias("t"), F.col("row")[lang].alias("lang"))
    df = df.withColumn("words", words_of(F.col("t")))
    return df.select(
        "row", "t", "lang", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length("t").cast("long").alias("n_chars"),
        (F.length("t") - F.length(F.array_join("words", ""))).cast("long").alias("blank"),
        *(F.regexp_count("t", F.lit(p)).cast("long").alias(k) for k, p in (("symbol", f"[{SYMBOLS}]"), ("upper", "[A-Z]"), ("digit", "[0-9]"), ("wide", r"[^\x00-\x7F]"), ("stop", r"[.,;:!?'\"()\-]"))),
    ).withColumn("rest", F.col("n_chars") - sum(F.col(k) for k in CLASSES[:-1]))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common_share: float = 0.0025, least_words: int = 4000) -> DataFrame:
    """(lang, chars array, words map) for each language of at least `least_words` words, and (null, chars array, null) for all rows."""
    base = docs.select(F.struct("*").alias("row")).select(F.coalesce(F.col("row")[text], F.lit("")).alias("t"), F.col("row")[lang].alias("lang"))
    counts = base.where("lang is not null").select("lang", F.explode(words_of(F.col("t"))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "quality-words")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("size")).where(F.col("size") >= least_words)
    common = counts.join(F.broadcast(sizes), "lang").where(F.col("n") >= common_share * F.col("size"))
    words = common.groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", (F.col("n") / F.col("size")).alias("q"))))).alias("ref_words"))
    cells = written(base_columns(docs, text, lang).groupBy("lang").agg(*(F.sum(k).alias(k) for k in CLASSES)), "quality-cells")
    own = cells.join(F.broadcast(sizes), "lang").select("lang", *CLASSES).join(words, "lang", "left")
    scripts = cells.agg(*(F.sum(k).alias(k) for k in CLASSES)).withColumns({"rest": F.col("rest") + F.col("wide"), "wide": F.lit(0).cast("long")})
    pooled = scripts.select(F.lit(None).cast("string").alias("lang"), *CLASSES, F.lit(None).cast("map<string,double>").alias("ref_words"))
    own = own.withColumn("ref_words", F.coalesce("ref_words", F.create_map().cast("map<string,double>")))
    size = F.greatest(F.lit(1), sum(F.col(k) for k in CLASSES))
    return own.unionByName(pooled).select("lang", F.array(*(F.coalesce(F.col(k) / size, F.lit(0.0)) for k in CLASSES)).alias("ref_chars"), "ref_words")


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_chars_distance: float = 0.25,
    max_words_distance: float = 0.32,
    min_chars: int = 600,
    min_words: int = 100,
    common_share: float = 0.0025,
    least_words: int = 4000,
) -> DataFrame:
    """Every row as the struct `row`, with the counts, both distances (null where not judged), base_failed and kept."""
    refs = [(r["lang"], r["ref_chars"], r["ref_words"]) for r in references(docs, text, lang, common_share, least_words).collect()]  # one for each language
    own = docs.sparkSession.createDataFrame([r for r in refs if r[0] is not None], "lang string, own_chars array<double>, ref_words map<string,double>")
    pooled = next(chars for name, chars, _ in refs if name is None)
    known = sorted({w for _, _, words in refs for w in words or ()})
    df = base_columns(docs, text, lang).join(F.broadcast(own), "lang", "left").withColumn("ref_chars", F.coalesce("own_chars", F.array(*map(F.lit, pooled))))
    none = F.col("own_chars").isNull()
    df = df.withColumns({"rest": F.when(none, F.col("rest") + F.col("wide")).otherwise(F.col("rest")), "wide": F.when(none, F.lit(0)).otherwise(F.col("wide"))})

    common = F.sort_array(F.filter("words", lambda w: w.isin(known))) if known else F.array().cast("array<string>")

    def word_divergence(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda w, i: F.when((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0))) == w), F.lit(-1)).otherwise(i)), lambda i: i >= 0)

        def of_runs(at: Column) -> Column:
            cells = F.transform(at, lambda i, k: F.struct(((F.coalesce(F.get(at, k + 1), F.size(s)) - i) / F.col("n_words")).alias("p"), F.try_element_at(F.col("ref_words"), F.get(s, i)).alias("q")))
            cells = F.filter(cells, lambda c: c["q"].isNotNull())
            zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
            return F.aggregate(cells, zero, lambda a, c: F.struct((a["d"] + half_term(c["p"], c["q"])).alias("d"), (a["p"] + c["p"]).alias("p"), (a["q"] + c["q"]).alias("q")))

        return let(firsts, of_runs)

    judged = (F.col("n_words") >= min_words) & F.col("ref_words").isNotNull()
    df = df.withColumn("seen", F.when(judged, let(common, word_divergence)))
    all_q = F.aggregate(F.map_values("ref_words"), F.lit(0.0), lambda a, q: a + q)
    rest_p, rest_q = F.greatest(F.lit(0.0), 1 - F.col("seen")["p"]), F.greatest(F.lit(0.0), 1 - all_q)
    words_js = F.col("seen")["d"] + F.greatest(F.lit(0.0), all_q - F.col("seen")["q"]) / 2 + half_term(rest_p, rest_q)
    chars_js = sum(half_term(F.col(k) / F.col("n_chars"), F.get("ref_chars", F.lit(i))) for i, k in enumerate(CLASSES))
    df = df.select(
        "row", "n_words",
        (F.col("n_chars") - F.col("blank")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        duplicate_lines(F.col("t")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.when(F.col("n_chars") >= min_chars, F.sqrt(F.greatest(F.lit(0.0), chars_js))).alias("chars_distance"),
        F.when(judged, F.sqrt(F.greatest(F.lit(0.0), words_js))).alias("words_distance"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.coalesce("chars_distance", F.lit(0.0)) > max_chars_distance) | (F.coalesce("words_distance", F.lit(0.0)) > max_words_distance)
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs).select(F.col("row")["doc_id"].alias("doc_id"), *counts, "base_failed", "kept")


def _half(p: str, q: str) -> str:
    one = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({p} + {q})) ELSE 0.0 END"
    return f"(({one(p)}) + ({one(q)})) / 2"


_CLASS_COUNTS = ", ".join(
    ["length(t) - length(array_to_string(ws, ''))"]
    + [f"len(regexp_extract_all(t, '{p}'))" for p in ("[A-Z]", "[0-9]", r"[^\x00-\x7F]", r"[.,;:!?''\"()\-]", f"[{SYMBOLS}]")]
)
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
wc AS (SELECT lang, word, count(*) AS n FROM u WHERE lang IS NOT NULL GROUP BY ALL),
big AS (SELECT lang, sum(n) AS size FROM wc GROUP BY lang HAVING sum(n) >= 4000),
q AS (SELECT '=' || lang AS ref, word, (n / size)::DOUBLE AS q FROM wc JOIN big USING (lang) WHERE n >= 0.0025 * size),
d AS (SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM big) THEN '=' || lang ELSE '*' END AS ref, len(ws) AS n_words, length(t) AS n_chars, [{_CLASS_COUNTS}] AS six,
      len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines FROM w),
c AS (SELECT doc_id, ref, n_chars, list_append(six, n_chars - list_sum(six)) AS own, [six[1], six[2], six[3], 0, six[5], six[6], n_chars - list_sum(six) + six[4]] AS any_script FROM d),
k AS (SELECT doc_id, ref, n_chars, unnest(CASE WHEN ref = '*' THEN any_script ELSE own END) AS v, unnest(range(7)) AS k FROM c),
kr AS (SELECT ref, k, sum(v) AS v FROM (SELECT ref, k, v FROM k WHERE ref <> '*' UNION ALL SELECT '*', unnest(range(7)), unnest(any_script) FROM c) GROUP BY ALL),
kq AS (SELECT ref, k, (v / greatest(1, sum(v) OVER (PARTITION BY ref)))::DOUBLE AS q FROM kr),
cj AS (SELECT doc_id, sum({_half("(v / n_chars)", "q")}) AS js FROM k JOIN kq USING (ref, k) WHERE n_chars >= 600 GROUP BY doc_id),
wn AS (SELECT doc_id, word, count(*) AS c FROM u GROUP BY ALL),
wq AS (SELECT d.doc_id, coalesce(c, 0) / n_words AS p, q.q FROM d JOIN q USING (ref) LEFT JOIN wn ON wn.doc_id = d.doc_id AND wn.word = q.word WHERE n_words >= 100),
wj AS (SELECT doc_id, sum({_half("p", "q")}) AS js, greatest(0.0, 1 - sum(p)) AS rp, greatest(0.0, 1 - sum(q)) AS rq FROM wq GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM w WHERE len(ws) >= 8),
g2 AS (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM g WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM g GROUP BY doc_id, g HAVING count(*) > 1)),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM g2 GROUP BY doc_id),
o AS (SELECT d.*, coalesce(r.n, 0) AS rep, sqrt(greatest(0.0, cj.js)) AS cd, sqrt(greatest(0.0, wj.js + {_half("rp", "rq")})) AS wd
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN cj USING (doc_id) LEFT JOIN wj USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, (n_chars - six[1])::BIGINT AS word_chars, six[6]::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words,
       n_words < 20 OR 100 * rep > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * rep > 30 * n_words) AND NOT (coalesce(cd, 0.0) > 0.25 OR coalesce(wd, 0.0) > 0.32) AS kept
FROM o
"""
