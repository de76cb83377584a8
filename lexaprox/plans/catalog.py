"""The registered queries: each operator over whole tables, with its SQL where
that is not too slow.

The dictionary of most of them is the vocabulary of `benchmark`, weighted by how
often a word comes; the queries are one typo of each of its words, if that is
none itself. The flagship searches the vocabulary of all `documents` for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import layout, phonetic
from ..functions.costs import CostModel, whole_units
from ..functions.distance import distance, distance_sql, osa_within, unit_osa
from ..functions.normalize import normalize, sql_normalize, utf8_offset, utf16_offset
from ..functions.typo_scores import fingerprint, fingerprint_difference, hamming
from ..operators import evaluate as ev
from ..operators import phonetic_search as ps
from ..operators import search as se
from ..operators.dictionary import build, prefixes
from ..operators.fuzzy_index import Documents, fuzzy_search, index_terms, melt
from ..operators.highlight import highlight
from ..operators.query_language import condition
from ..operators.search import SearchConfig
from ..sources.text import log_weights, result_lines, word_counts
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, name: str = "benchmark") -> DataFrame:
    counts = word_counts(table(spark, sf_dir, name))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1
    return counts.select(place.cast("long").alias("input_index"), "term", F.least("n", F.lit(65535)).cast("int").alias("weight"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(items(spark, sf_dir), strict=False).persist()


def pairs(terms: DataFrame) -> DataFrame:
    """(qid, typo, right, kind): a typo of each term, its kind by the term's length."""
    kinds = list(ev.TYPOS)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("n") % 6 + 1).cast("int"))
    typo = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {text.replace('(w,', '(norm,')}" for k, (_, text) in ev.TYPOS.items()) + " END")
    made = terms.withColumn("kind", kind).select(F.col("id").alias("qid"), typo.alias("typo"), F.col("norm").alias("right"), "kind")
    return ev.usable_pairs(made, terms)


def queries_of(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("typo").alias("q"))


def searched(spark: SparkSession, sf_dir: str, config: SearchConfig = SearchConfig(), cm: CostModel = CostModel(), prefix: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    terms = dictionary(spark, sf_dir)
    found = pairs(terms)
    return terms, found, se.search(queries_of(found), terms, config, cm, prefix)


HITS = ["qid", "rank", "id", "norm", "cost", "weight", "input_index"]
_H = ", ".join(HITS)


@query()
def search_documents_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: mistyped benchmark words in the vocabulary of all documents."""
    counts = word_counts(table(spark, sf_dir, "documents"))
    named = counts.select(F.xxhash64("term").alias("input_index"), "term", F.least("n", F.lit(65535)).cast("int").alias("weight"))
    terms = build(named, strict=False).persist()
    return se.search(queries_of(pairs(dictionary(spark, sf_dir))), terms).select("qid", "rank", "id", "norm", "cost", "weight")


@query(f"WITH {sql.TERMS} SELECT id, norm, weight, input_index, n FROM dict")
def dict_build(spark, sf_dir):
    return dictionary(spark, sf_dir).select("id", "norm", "weight", "input_index", "n")


_RAW = r"[A-Za-zÀ-ÖØ-öø-ÿ]+"


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '{_RAW}')) AS source FROM documents), c AS (SELECT source, least(count(*), 65535) AS weight FROM w GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY weight DESC, source) - 1 AS input_index, {sql_normalize('source')} AS norm FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY weight DESC, input_index) AS k FROM i)
SELECT row_number() OVER (ORDER BY norm) - 1 AS id, norm, source, weight, input_index, length(norm) AS n FROM b WHERE k = 1""")
def dict_build_normalized(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_RAW), F.lit(0))).alias("term"))
    counts = words.groupBy("term").agg(F.least(F.count(F.lit(1)), F.lit(65535)).cast("int").alias("weight"))
    named = counts.withColumn("input_index", F.row_number().over(Window.orderBy(F.desc("weight"), "term")) - 1)
    return build(named, strict=False).select("id", "norm", "source", "weight", "input_index", "n")


@query(f"""WITH {sql.TERMS}, p AS (SELECT unnest(range(0, n + 1)) AS k, norm, weight, n FROM dict)
SELECT substr(norm, 1, k) AS prefix, count(*) AS terms, max(weight) AS max_weight, min(n) AS len_min, max(n) AS len_max FROM p GROUP BY 1""")
def dict_prefix_aggregates(spark, sf_dir):
    return prefixes(dictionary(spark, sf_dir)).drop("below_mask")


def _normalized(case: bool, marks: bool) -> tuple[Query, str]:
    def run(spark, sf_dir):
        norm = normalize(F.col("text"), case, marks)
        return table(spark, sf_dir, "documents").select("doc_id", F.length(norm).alias("n"), F.md5(norm.cast("binary")).alias("digest"))

    return run, f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {sql_normalize('text', case, marks)} AS x FROM documents)"


for _name, _case, _marks in (("normalize_default", True, True), ("normalize_case_only", True, False), ("normalize_marks_only", False, True)):
    QUERIES[_name], SQL[_name] = _normalized(_case, _marks)


@query("SELECT doc_id, strlen(x) AS utf8, length(x) + length(regexp_replace(x, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS utf16 FROM (SELECT doc_id, substr(text, 1, length(text) // 2) AS x FROM documents)")
def text_offsets(spark, sf_dir):
    half = F.expr("CAST(length(text) div 2 AS INT)")
    return table(spark, sf_dir, "documents").select("doc_id", utf8_offset(F.col("text"), half).alias("utf8"), utf16_offset(F.col("text"), half).alias("utf16"))


@query(sql.NEIGHBOURS)
def layout_neighbours(spark, sf_dir):
    return layout.neighbours_frame(spark)


_PAIRS = f"WITH RECURSIVE {sql.TERMS}, {sql.TYPOS}, asked AS (SELECT typo AS q, correct AS t FROM pairs), "


@query(_PAIRS + sql.matrices("asked") + " SELECT qid, cost, (cost + 15) // 16 AS units FROM pairs JOIN scored ON q = typo AND t = correct")
def weighted_distance(spark, sf_dir):
    found = pairs(dictionary(spark, sf_dir)).withColumn("cost", distance("typo", "right"))
    return found.select("qid", "cost", whole_units(F.col("cost")).alias("units"))


@query(SQL["weighted_distance"])
def weighted_distance_without_python(spark, sf_dir):
    found = pairs(dictionary(spark, sf_dir)).withColumn("cost", distance_sql("typo", "right"))
    return found.select("qid", "cost", whole_units(F.col("cost")).alias("units"))


@query(_PAIRS + sql.matrices("asked", last="list_min(list_transform(range(0, n + 1), lambda j: d[(j + 1) * (m + 1)]))") + " SELECT qid, cost FROM pairs JOIN scored ON q = typo AND t = correct")
def prefix_distance(spark, sf_dir):
    return pairs(dictionary(spark, sf_dir)).select("qid", distance("typo", "right", prefix=True).alias("cost"))


@query(_PAIRS + sql.matrices("asked", unit=True) + " SELECT qid, cost AS osa, CASE WHEN cost <= 1 THEN cost END AS within_1 FROM pairs JOIN scored ON q = typo AND t = correct")
def unit_distance(spark, sf_dir):
    return pairs(dictionary(spark, sf_dir)).select("qid", unit_osa("typo", "right").alias("osa"), osa_within("typo", "right", 1).alias("within_1"))


@query(f"WITH {sql.TERMS}, {sql.TYPOS} SELECT q, id, levenshtein(q, norm) AS d FROM (SELECT DISTINCT q FROM queries), dict WHERE abs(length(q) - length(norm)) <= 2 AND levenshtein(q, norm) <= 2")
def levenshtein_within_2(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    return se.within_levenshtein(queries_of(pairs(terms)), terms).select("q", "id", "d")


@query(sql.search() + f" SELECT {_H} FROM hits")
def search_coarse(spark, sf_dir):
    return searched(spark, sf_dir)[2].select(HITS)


@query(sql.search(ranking="exact") + f" SELECT {_H} FROM hits")
def search_exact(spark, sf_dir):
    return searched(spark, sf_dir, SearchConfig(ranking="exact"))[2].select(HITS)


@query()
def search_high_recall(spark, sf_dir):
    """Budget 48. In SQL nearly all pairs would be left; tests hold it against brute force."""
    return searched(spark, sf_dir, SearchConfig.high_recall())[2].select(HITS)


@query(sql.search(layout="azerty") + f" SELECT {_H} FROM hits")
def search_azerty(spark, sf_dir):
    return searched(spark, sf_dir, cm=CostModel.for_layout("azerty"))[2].select(HITS)


@query(sql.search(queries="folded", extra=", folded AS (SELECT qid, lower(q) AS q FROM queries)") + f" SELECT {_H} FROM hits")
def search_folded(spark, sf_dir):
    """Typos in capitals with an accent on each e and a, folded as terms are."""
    terms = dictionary(spark, sf_dir)
    asked = queries_of(pairs(terms)).withColumn("q", F.translate(F.upper("q"), "EA", "ÉÀ"))
    return se.search_text(asked, terms).select(HITS)


@query(sql.search(budget=16, prefix=True, queries="begun", extra=", begun AS (SELECT qid, substr(q, 1, 4) AS q FROM queries)") + f" SELECT {_H} FROM hits")
def search_prefix(spark, sf_dir):
    """Autocomplete of the first four letters of each typo, an edit at most."""
    terms = dictionary(spark, sf_dir)
    asked = queries_of(pairs(terms)).withColumn("q", F.substring("q", 1, 4))
    return se.search_prefix(asked, terms, SearchConfig(budget=16)).select(HITS)


@query(f"WITH {sql.TERMS} SELECT 0 AS qid, row_number() OVER (ORDER BY weight DESC, id) AS rank, id, norm, 0 AS cost, weight, input_index FROM dict ORDER BY rank LIMIT 10")
def search_prefix_of_nothing(spark, sf_dir):
    return se.search_prefix(spark.createDataFrame([(0, "")], "qid long, q string"), dictionary(spark, sf_dir)).select(HITS)


@query(f"WITH RECURSIVE {sql.TERMS}, {sql.TYPOS}, near AS (SELECT q, id, norm AS t, weight, input_index FROM (SELECT DISTINCT q FROM queries), dict WHERE abs(length(q) - length(norm)) <= 2 AND levenshtein(q, norm) <= 4), " + sql.matrices("near", unit=True) +
       ", best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cost, weight DESC, input_index) AS rank FROM near JOIN scored USING (q, t) WHERE cost <= 2) SELECT qid, rank, id, cost FROM queries JOIN best USING (q) WHERE rank <= 10")
def baseline_osa_2(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    return se.baseline_osa2(queries_of(pairs(terms)), terms).select("qid", "rank", "id", "cost")


_CUTS = "list_distinct(list_concat([{w}], list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1))))"


@query(f"WITH {sql.TERMS}, {sql.TYPOS}, a AS (SELECT q, unnest({_CUTS.format(w='q')}) AS v FROM (SELECT DISTINCT q FROM queries)), b AS (SELECT id, unnest({_CUTS.format(w='norm')}) AS v FROM dict) SELECT DISTINCT q, id FROM a JOIN b USING (v)")
def deletion_variant_join(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    return se.deletion_join(queries_of(pairs(terms)), terms).select("q", "id")


@query()
def highlight_hits(spark, sf_dir):
    """Typed parts of the best hits; tests hold it against cases worked by hand."""
    terms, found, hits = searched(spark, sf_dir)
    both = hits.join(queries_of(found), "qid").withColumn("h", highlight(F.col("q"), F.col("term"), F.col("norm"), F.col("cost")))
    chars = F.transform("h.ranges", lambda r: F.concat_ws("-", r["chars"]["start"], r["chars"]["end"]))
    return both.select("qid", "rank", F.array_join(chars, ",").alias("spans"), F.col("h.aligned.chars.end").alias("aligned_to"), F.col("h.cells").alias("cells"), F.col("h.error").alias("error"))


@query(f"WITH {sql.TERMS}, {sql.TYPOS} SELECT qid, {sql.soundex('typo')} AS key, count(id) AS terms FROM pairs LEFT JOIN dict ON {sql.soundex('typo')} = {sql.soundex('norm')} GROUP BY ALL")
def soundex_bucket_sizes(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    found = pairs(terms).select("qid", phonetic.soundex("typo").alias("key"))
    return found.join(terms.select("id", phonetic.soundex("norm").alias("key")), "key", "left").groupBy("qid", "key").agg(F.count("id").alias("terms"))


@query(f"WITH RECURSIVE {sql.TERMS}, {sql.TYPOS}, near AS (SELECT q, id, norm, norm AS t, weight FROM (SELECT DISTINCT q FROM queries), dict WHERE {sql.soundex('q')} = {sql.soundex('norm')}), " + sql.matrices("near", unit=True) +
       ", best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cost, weight DESC, id) AS rank FROM near JOIN scored USING (q, t)) SELECT qid, rank, id, cost AS osa FROM queries JOIN best USING (q) WHERE rank <= 10")
def phonetic_bucket(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    return ps.same_sound(queries_of(pairs(terms)), terms, phonetic.soundex).select("qid", "rank", "id", "osa")


@query()
def phonetic_injection(spark, sf_dir):
    """Two Metaphone-like candidates among the hits of queries whose best is dear."""
    terms, found, hits = searched(spark, sf_dir)
    return ps.inject(hits, ps.same_sound(queries_of(found), terms, phonetic.metaphone), 2, gate=16)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(phonetic.spelling_rules(), "rule_from string, rule_to string")


_RULES = "rules(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in phonetic.spelling_rules()) + ")"


@query(f"WITH {sql.TERMS}, {sql.TYPOS}, {_RULES}, e AS (SELECT DISTINCT q, a, b, unnest(list_filter(range(1, length(q) + 1), lambda i: substr(q, i, length(a)) = a)) AS i FROM queries, rules) SELECT DISTINCT q, substr(q, 1, i - 1) || b || substr(q, i + length(a)) AS variant FROM e WHERE substr(q, 1, i - 1) || b || substr(q, i + length(a)) NOT IN ('', q)")
def rule_variants(spark, sf_dir):
    return ps.variants(queries_of(pairs(dictionary(spark, sf_dir))), rules(spark))


@query()
def rule_search(spark, sf_dir):
    """Rewritten queries cost one edit more; too many pairs for SQL."""
    terms = dictionary(spark, sf_dir)
    return ps.rule_search(queries_of(pairs(terms)), terms, rules(spark)).select("qid", "rank", "id", "cost")


@query(f"""WITH {sql.TERMS}, {sql.TYPOS}, a AS (SELECT typo, correct, len(list_filter(range(1, least(length(typo), length(correct)) + 1), lambda i: substr(typo, 1, i) = substr(correct, 1, i))) AS p FROM pairs),
b AS (SELECT *, len(list_filter(range(1, least(length(typo), length(correct)) - p + 1), lambda i: right(typo, i) = right(correct, i))) AS s FROM a),
c AS (SELECT substr(typo, p - l + 1, length(typo) - s + r - p + l) AS rule_from, substr(correct, p - l + 1, length(correct) - s + r - p + l) AS rule_to FROM b, (VALUES (0), (1)) x(l), (VALUES (0), (1)) y(r)
WHERE length(typo) - p - s BETWEEN 1 AND 3 AND length(correct) - p - s BETWEEN 0 AND 3 AND p >= l AND s >= r)
SELECT rule_from, rule_to, count(*) AS n FROM c WHERE rule_from <> rule_to AND length(rule_from) <= 5 GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, rule_from, rule_to LIMIT 100""")
def mine_rules(spark, sf_dir):
    return ps.mine_rules(pairs(dictionary(spark, sf_dir)))


_RANKS = ", ranks AS (SELECT p.qid, p.kind, h.rank, coalesce(1.0 / h.rank, 0) AS rr FROM pairs p LEFT JOIN hits h ON h.qid = p.qid AND h.norm = p.correct)"


@query(sql.search() + _RANKS + " SELECT kind, count(*) AS n, round(avg(rr), 9) AS mrr, round(avg((rank IS NOT NULL AND rank = 1)::INT), 9) AS r_at_1, round(avg((rank IS NOT NULL)::INT), 9) AS r_at_10 FROM ranks GROUP BY kind")
def mrr_by_kind(spark, sf_dir):
    _, found, hits = searched(spark, sf_dir)
    return _rounded(ev.summary(ev.reciprocal_ranks(found, hits), "kind"), "mrr", "r_at_1", "r_at_10")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


_CUT = "list_filter(range(1, length({a}) + 1), lambda i: substr({a}, 1, i - 1) || substr({a}, i + 1) = {b})"
_TWIN = "len(list_filter({cut}, lambda i: i > 1 AND substr({a}, i, 1) = substr({a}, i - 1, 1) OR i < length({a}) AND substr({a}, i, 1) = substr({a}, i + 1, 1))) > 0"
_twin = lambda a, b: _TWIN.format(cut=_CUT.format(a=a, b=b), a=a)
_NEAR = " ".join(sorted(a + b for a, b in layout.neighbours("qwerty")))


@query(sql.search() + _RANKS + ", asked AS (SELECT typo AS q, correct AS t FROM pairs), " + sql.matrices("asked", unit=True).replace("dp", "du").replace("scored", "counted") + f""",
spots AS (SELECT qid, typo, correct, c.cost AS osa, list_filter(range(1, length(typo) + 1), lambda i: substr(typo, i, 1) <> substr(correct, i, 1)) AS places FROM pairs JOIN counted c ON c.q = typo AND c.t = correct),
named AS (SELECT qid, substr(typo, 1, 1) <> substr(correct, 1, 1) AS first_differs, CASE WHEN osa = 0 THEN 'same' WHEN osa >= 2 THEN 'two or more edits'
 WHEN length(typo) = length(correct) AND len(places) = 1 AND list_contains(string_split('{_NEAR.replace("'", "''")}', ' '), substr(typo, places[1], 1) || substr(correct, places[1], 1)) THEN 'neighbouring-key substitution'
 WHEN length(typo) = length(correct) AND len(places) = 1 THEN 'other substitution' WHEN length(typo) = length(correct) THEN 'transposition'
 WHEN length(typo) < length(correct) AND {_twin('correct', 'typo')} THEN 'missing doubled letter' WHEN length(typo) < length(correct) THEN 'missing letter'
 WHEN {_twin('typo', 'correct')} THEN 'extra doubled letter' ELSE 'extra letter' END AS category FROM spots),
both AS (SELECT qid, category FROM named UNION ALL SELECT qid, 'first letter differs' FROM named WHERE first_differs)
SELECT category, count(*) AS n, round(avg(rr), 9) AS mrr, round(avg((rank IS NOT NULL AND rank = 1)::INT), 9) AS r_at_1, round(avg((rank IS NOT NULL)::INT), 9) AS r_at_10 FROM both JOIN ranks USING (qid) GROUP BY category""".replace("both", "either"))
def mrr_by_category(spark, sf_dir):
    _, found, hits = searched(spark, sf_dir)
    return _rounded(ev.by_category(ev.reciprocal_ranks(ev.classify(found), hits)), "mrr", "r_at_1", "r_at_10")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, and the hits of both rankings from one join."""
    terms = dictionary(spark, sf_dir)
    found = pairs(terms)
    return found, *(se.search(queries_of(found), terms, SearchConfig(ranking=r)) for r in ("coarse", "exact"))


_TWO = sql.search() + """, best2 AS (SELECT q, id, norm, cost, weight, row_number() OVER (PARTITION BY q ORDER BY cost, weight DESC, id) AS rank FROM near JOIN scored USING (q, t) WHERE cost <= 32),
hits2 AS (SELECT qid, rank, id, norm, cost FROM queries JOIN best2 USING (q) WHERE rank <= 10)"""


@query(_TWO + _RANKS + """, other AS (SELECT p.qid, coalesce(1.0 / h.rank, 0) AS rr FROM pairs p LEFT JOIN hits2 h ON h.qid = p.qid AND h.norm = p.correct), d AS (SELECT r.rr - o.rr AS d FROM ranks r JOIN other o USING (qid))
SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d) / sqrt(count(*)), 9) AS se, sum((d <> 0)::INT) AS differ FROM d""")
def paired_difference(spark, sf_dir):
    found, coarse, exact = _both(spark, sf_dir)
    out = ev.paired_difference(ev.reciprocal_ranks(found, coarse), ev.reciprocal_ranks(found, exact))
    return _rounded(out.select("n", "mean", "se", "differ"), "mean", "se")


@query(_TWO + """, x AS (SELECT qid, list(id ORDER BY rank) AS x FROM hits GROUP BY qid), y AS (SELECT qid, list(id ORDER BY rank) AS y FROM hits2 GROUP BY qid)
SELECT qid, CASE WHEN x IS NULL THEN 1.0 ELSE round(len(list_intersect(x, y)) / greatest(len(x), len(y)), 9) END AS overlap, coalesce(x = y, true) AS identical FROM queries LEFT JOIN x USING (qid) LEFT JOIN y USING (qid)""")
def top10_overlap(spark, sf_dir):
    found, coarse, exact = _both(spark, sf_dir)
    return _rounded(ev.overlap(coarse, exact, found), "overlap")


@query(sql.search() + ", t AS (SELECT qid, count(*) > count(DISTINCT cost) AS tied FROM hits GROUP BY qid) SELECT count(*) AS queries, round(avg(coalesce(tied, false)::INT), 9) AS ties FROM queries LEFT JOIN t USING (qid)")
def ties_at_10(spark, sf_dir):
    _, found, hits = searched(spark, sf_dir)
    return _rounded(ev.ties(hits, found), "ties")


@query(sql.search() + ", o AS (SELECT rank, cost, row_number() OVER (PARTITION BY rank ORDER BY cost) - 1 AS spot, count(*) OVER (PARTITION BY rank) AS n FROM hits) SELECT rank, cost AS value FROM o WHERE spot = least(floor(n * 0.95), n - 1)")
def percentile_pick(spark, sf_dir):
    return ev.percentile_pick(searched(spark, sf_dir)[2], "cost", 0.95, "rank")


@query(_PAIRS + sql.matrices("asked") + ", " + sql.matrices("asked", unit=True).replace("dp", "du").replace("scored", "counted") +
       f" SELECT c.cost AS osa, count(*) AS pairs, count_if(s.cost <= 32) AS within_32, count_if(s.cost <= 48) AS within_48, count_if(s.cost <= 64) AS within_64, count_if({sql.soundex('typo')} = {sql.soundex('correct')}) AS same_key FROM pairs JOIN scored s ON s.q = typo AND s.t = correct JOIN counted c ON c.q = typo AND c.t = correct GROUP BY c.cost")
def recall_decomposition(spark, sf_dir):
    found = pairs(dictionary(spark, sf_dir))
    return ev.reachability(found.withColumn("osa", unit_osa("typo", "right")).withColumn("cost", distance("typo", "right")), phonetic.soundex)


@query(f"WITH {sql.TERMS}, {sql.TYPOS} SELECT qid, typo, correct, kind FROM pairs")
def usable_pairs(spark, sf_dir):
    return pairs(dictionary(spark, sf_dir)).select("qid", "typo", F.col("right").alias("correct"), "kind")


@query(f"WITH {sql.TERMS} SELECT id, ('0x' || substr(md5('split' || norm), 1, 12))::BIGINT % 100 AS bucket FROM dict")
def hash_split(spark, sf_dir):
    return dictionary(spark, sf_dir).select("id", ev.hash_bucket("norm", "split").alias("bucket"))


@query(f"WITH {sql.TERMS} SELECT id, norm FROM dict WHERE starts_with(norm, 'th') AND NOT contains(norm, 'e') OR ends_with(norm, 'ing') AND contains(norm, 'on') OR norm = 'the'")
def query_language(spark, sf_dir):
    return dictionary(spark, sf_dir).filter(condition("^th !e | ing$ on | =the", F.col("norm"))).select("id", "norm")


_FP = "list_transform(range(32, 128), lambda c: length({w}) - length(replace({w}, chr(c::INT), '')))"


@query(f"WITH {sql.TERMS}, {sql.TYPOS}, h AS (SELECT q, id, abs(length(q) - n) + len(list_filter(range(1, least(length(q), n) + 1), lambda i: substr(q, i, 1) <> substr(norm, i, 1))) AS hamming, list_sum(list_transform(list_zip({_FP.format(w='q')}, {_FP.format(w='norm')}), lambda p: abs(p[1] - p[2])))::BIGINT AS difference FROM (SELECT DISTINCT q FROM queries), dict WHERE abs(length(q) - n) <= 2) SELECT * FROM h WHERE hamming <= 2 OR difference <= 2")
def byte_candidates(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    asked = queries_of(pairs(terms)).select("q").distinct().withColumn("qfp", fingerprint("q")).withColumn("n", F.explode(F.expr("sequence(length(q) - 2, length(q) + 2)")))
    both = asked.join(terms.select("id", "norm", "n", fingerprint("norm").alias("fp")), "n")
    return both.select("q", "id", hamming("q", "norm").alias("hamming"), fingerprint_difference("qfp", "fp").cast("long").alias("difference")).filter("hamming <= 2 OR difference <= 2")


@query()
def fuzzy_index_search(spark, sf_dir):
    """The older search over the same dictionary; single precision scores."""
    terms = dictionary(spark, sf_dir)
    return fuzzy_search(queries_of(pairs(terms)), index_terms(terms.select(F.col("id").alias("term_index"), F.col("norm").alias("term")))).select("qid", "rank", "term_index", F.round("score", 4).alias("score"), "hamming_distance")


@query()
def fuzzy_documents(spark, sf_dir):
    """Parts by name, brand and type: mistyped names of colours."""
    docs = melt(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand", "p_type")
    asked = table(spark, sf_dir, "part").select(F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 40)).alias("q")).distinct().select(F.xxhash64("q").alias("qid"), "q")
    return Documents({"p_name": 2.0, "p_brand": 1.0, "p_type": 1.0}).search(asked, docs).select("qid", "rank", "doc_index", F.round("score", 4).alias("score"))


@query(f"WITH w AS (SELECT unnest(regexp_extract_all(translate(text, {sql.AZ}), '[a-z]+')) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM w GROUP BY term) SELECT term, round(65535 * ln(1 + n) / (SELECT ln(1 + max(n)) FROM c))::INT AS weight FROM c")
def log_weight_dictionary(spark, sf_dir):
    """Weights on a logarithmic scale."""
    return log_weights(word_counts(table(spark, sf_dir, "documents")))


@query(sql.search() + " SELECT qid, count(*) || chr(9) || '0' || chr(10) || string_agg(norm || chr(9) || cost || chr(9) || weight, chr(10) ORDER BY rank) AS lines FROM hits GROUP BY qid")
def result_text(spark, sf_dir):
    return result_lines(searched(spark, sf_dir)[2]).select("qid", F.array_join("lines", "\n").alias("lines"))
