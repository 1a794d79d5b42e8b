"""More queries over the driver's tables: readers and writers, slices, plot data, pair texts, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import calibration, features, graph, metrics, profiling, quality, shift
from ..sources import tables
from ..streaming.resolve import windowed_counts
from . import biz
from .catalogue import _CLUSTERS, _FENCE, _NUM, _PAIRS, _RANKED, _SETS, _entities, _hydrated, _jaro_winkler, _numbers, _pairs, _resolved, _scored, _sets, _taken, query, r6
from .lists import joined
from .shared import folder

# -- readers and writers: files are written to the shared folder and read back ------------


def _sources(spark, d) -> str:
    """The three sources as tab-separated files; each query writes its own."""
    import uuid

    place = f"{folder(spark)}/weftlink-files-{uuid.uuid4().hex}"
    rows = biz.records(spark, d).select("source", "entity_id", "business_name", "business_address", "country")
    for n in (1, 2, 3):
        one = rows.where(F.col("source") == f"S{n}").drop("source")
        one.write.csv(f"{place}/test_source{n}.tsv", sep="\t", header=True, quote="", emptyValue="", nullValue="")
    return place


@query(f"WITH {biz.BIZ} SELECT entity_id, source, pos, nullif(business_name, '') AS business_name, nullif(business_address, '') AS business_address, nullif(country, '') AS country FROM biz")
def tsv_records(spark, d):
    place = _sources(spark, d)
    parts = [tables.read_records(spark, f"{place}/test_source{n}.tsv") for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("entity_id", "source", "pos", "business_name", "business_address", "country")


@query(f"WITH {biz.BIZ} SELECT entity_id FROM biz WHERE source <> 'S1'")
def match_target_ids(spark, d):
    return tables.read_targets(spark, _sources(spark, d))


@query(f"WITH {biz.BIZ} SELECT entity_id FROM biz ORDER BY pos, entity_id LIMIT 25")
def first_records(spark, d):
    return tables.first_rows(biz.records(spark, d), 25).select("entity_id")


@query(f"WITH {biz.RULES} SELECT s1_id, matches AS ids, true AS has_tab FROM lists")
def list_lines(spark, d):
    place = f"{_sources(spark, d)}/matching_results"
    tables.write_lists(_resolved(spark, d), place, "matches", "matched_entity_ids")
    header, lines = tables.read_lines(spark, place)
    if quality.header_problem(header, ("source1_entity_id", "matched_entity_ids")):
        raise ValueError(header)
    return quality.parsed(lines).select("s1_id", joined(F.col("ids")).alias("ids"), "has_tab")


@query(f"WITH {biz.RULES} SELECT s1_id, unnest(string_split(matches, ',')) AS id FROM lists WHERE matches <> ''")
def list_items(spark, d):
    text = F.concat(F.lit(" "), F.array_join("matches", " , "), F.lit(",, "))
    return _resolved(spark, d).select("s1_id", F.explode(T.list_items(text)).alias("id"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The batch form of the windowed counts that run on a stream."""
    out = windowed_counts(biz.table(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:00").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# -- slices, weights, plot data ----------------------------------------------------------


@query(f"WITH {biz.LABELS} SELECT label, count(*) AS n, min(weight) AS min, round(avg(weight), 6) AS mean, max(weight) AS max, round(sum(weight) ** 2 / sum(weight * weight), 6) AS n_eff FROM cal GROUP BY label")
def weight_summary(spark, d):
    out = shift.weight_summary(biz.scored_labels(spark, d), by=["label"])
    return out.select("label", "n", "min", r6("mean", "mean"), "max", r6("n_eff", "n_eff"))


@query(f"""WITH {_SETS}, c AS (SELECT CASE WHEN lang = 'fr' THEN 'shifted' ELSE 'usual' END AS slice, ro.*, CASE WHEN label = 1 THEN has1 ELSE has0 END::INT AS inside FROM ro JOIN documents USING (doc_id) WHERE lang IS NOT NULL)
 SELECT slice, round(avg(inside), 6) AS coverage, round(avg(size), 6) AS mean_size, count_if(decision = 1 AND label = 1)::BIGINT AS tp, count_if(decision = 1 AND label = 0)::BIGINT AS fp, count_if(decision = 0 AND label = 1)::BIGINT AS fn FROM c GROUP BY slice""")
def conformal_slices(spark, d):
    rows = _sets(spark, d).join(biz.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    parts = [calibration.evaluated(rows.where(on)).withColumn("slice", F.lit(name)) for name, on in (("shifted", F.col("lang") == "fr"), ("usual", F.col("lang") != "fr"))]
    return parts[0].unionByName(parts[1]).where(F.col("coverage").isNotNull()).select("slice", r6("coverage", "coverage"), r6("mean_size", "mean_size"), "tp", "fp", "fn")


@query(f"WITH {biz.BLOCKS}, {biz.TRUTH}, j AS (SELECT x.country, b.s1_id, b.cand_id, t.s1_id IS NOT NULL AS label, left(x.name_clean, 12) = left(y.name_clean, 12) AS yes FROM blocked b JOIN canon x ON x.entity_id = b.s1_id JOIN canon y ON y.entity_id = b.cand_id LEFT JOIN truth t ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id) SELECT country, count_if(yes AND label)::BIGINT AS tp, count_if(yes AND NOT label)::BIGINT AS fp, count_if(NOT yes AND label)::BIGINT AS fn FROM j GROUP BY country")
def country_slices(spark, d):
    pairs, records = _pairs(spark, d)
    rows = features.hydrated(features.labelled(pairs, biz.true_links(spark, d)), records, ("name_clean", "country"))
    yes = F.substring("a_name_clean", 1, 12) == F.substring("b_name_clean", 1, 12)
    return rows.groupBy(F.col("a_country").alias("country")).agg(*metrics.pair_counts(yes, F.col("label")))


@query("WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) OR coalesce(abs((value - m) / s) > 3, false) AS any_flag FROM events, f")
def any_flags(spark, d):
    rows = biz.table(spark, d, "events").select("event_id", "value")
    both = profiling.zscore_flags(profiling.iqr_flags(rows, ["value"]), ["value"])
    return both.select("event_id", profiling.any_of(["iqr_value", "z_value"]).alias("any_flag"))


@query(f"WITH f AS (SELECT {_FENCE}, " + ", ".join(f"median({c}) AS m_{i}" for i, c in enumerate(_NUM)) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(any_value(q1_{i}), 6) AS q1, round(any_value(m_{i}), 6) AS median, round(any_value(q3_{i}), 6) AS q3, (min({c}) FILTER (WHERE {c} BETWEEN q1_{i} - 1.5 * (q3_{i} - q1_{i}) AND q3_{i} + 1.5 * (q3_{i} - q1_{i})))::DOUBLE AS whisker_low, (max({c}) FILTER (WHERE {c} BETWEEN q1_{i} - 1.5 * (q3_{i} - q1_{i}) AND q3_{i} + 1.5 * (q3_{i} - q1_{i})))::DOUBLE AS whisker_high, count_if(NOT {c} BETWEEN q1_{i} - 1.5 * (q3_{i} - q1_{i}) AND q3_{i} + 1.5 * (q3_{i} - q1_{i}))::BIGINT AS n_outside FROM lineitem, f" for i, c in enumerate(_NUM)))
def box_stats(spark, d):
    return profiling.box_stats(_numbers(spark, d), _NUM).select("name", r6("q1", "q1"), r6("median", "median"), r6("q3", "q3"), "whisker_low", "whisker_high", "n_outside")


@query("WITH s AS (SELECT min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, stddev_samp(value) * count(value) ** -0.2 AS h, count(value) AS n FROM events), g AS (SELECT i::INT AS i, low + i * ((high - low) / 39) AS x, h, n FROM s, range(40) t(i)) SELECT i, round(x, 6) AS point, round(sum(exp(-0.5 * ((value - x) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM g, events WHERE value IS NOT NULL GROUP BY i, x")
def value_density(spark, d):
    out = profiling.density_grid(biz.table(spark, d, "events"), "value", 40)
    low = out.agg(F.min("point"), F.max("point")).first()
    step = (low[1] - low[0]) / 39
    return out.select(F.round((F.col("point") - low[0]) / step).cast("int").alias("i"), r6("point", "point"), F.round("density", 8).alias("density"))


# -- pair texts --------------------------------------------------------------------------

_WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"


def _word_pairs(a: str) -> str:
    w = _WORDS.format(a)
    return f"list_distinct(list_transform(range(1, greatest(len({w}), 1)), lambda i: array_to_string(list_slice({w}, i, i + 1), ' ')))"


def _prefix(a: str, b: str) -> str:
    return f"list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i)))::INT"


@query(f"WITH {_PAIRS}, g AS (SELECT s1_id, cand_id, a, b, {_word_pairs('a')} AS x, {_word_pairs('b')} AS y FROM pairs) SELECT s1_id, cand_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END, 6) AS bigram_jaccard, {_prefix('a', 'b')} AS n_prefix, {_prefix('reverse(a)', 'reverse(b)')} AS n_suffix FROM g")
def pair_word_runs(spark, d):
    a, b = F.col("a_name_clean"), F.col("b_name_clean")
    return _hydrated(spark, d).select("s1_id", "cand_id", r6(S.word_ngram_jaccard(a, b), "bigram_jaccard"), S.common_prefix(a, b).alias("n_prefix"), S.common_suffix(a, b).alias("n_suffix"))


_SIDES = ("north", "south", "east", "west", "central", "main")


@query(f"WITH {_PAIRS}, n AS (SELECT s1_id, cand_id, a || ' ' || list_extract({list(_SIDES)}, (length(a) % 6 + 1)::INT) AS a, b || ' ' || list_extract({list(_SIDES)}, (length(b) % 6 + 1)::INT) AS b FROM pairs), w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(a, ' '), lambda x: x IN {_SIDES[:5]}))) AS x, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda x: x IN {_SIDES[:5]}))) AS y FROM n) SELECT s1_id, cand_id, len(x) > 0 AND len(y) > 0 AND x <> y AS differ FROM w")
def pair_directions(spark, d):
    named = lambda c: F.concat(c, F.lit(" "), F.element_at(F.array(*map(F.lit, _SIDES)), F.char_length(c) % 6 + 1))
    return _hydrated(spark, d).select("s1_id", "cand_id", S.directions_differ(named(F.col("a_name_clean")), named(F.col("b_name_clean"))).alias("differ"))


@query(f"WITH {_PAIRS} SELECT s1_id, cand_id, coalesce(aa = ba AND aa <> '' AND CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(replace(a, 'ß', '@'), replace(b, 'ß', '@')) / greatest(length(a), length(b))::DOUBLE END < 0.5, false) AS apart FROM pairs WHERE NOT regexp_matches(a || ' ' || b, '\\b(north|south|east|west|central)\\b')")
def pair_stay_apart(spark, d):
    a, b = F.col("a_name_clean"), F.col("b_name_clean")
    rows = _hydrated(spark, d).where(~F.concat(a, F.lit(" "), b).rlike(r"\b(north|south|east|west|central)\b"))
    return rows.select("s1_id", "cand_id", S.must_stay_apart(a, b, F.col("a_addr_clean"), F.col("b_addr_clean")).alias("apart"))


@query()
def pair_damerau(spark, d):
    return _hydrated(spark, d).select("s1_id", "cand_id", S.damerau(F.col("a_name_clean"), F.col("b_name_clean")).alias("distance"))


def _token_set_sql() -> str:
    words = lambda a: f"list_sort(list_distinct({_WORDS.format(a)}))"
    text = lambda items: f"array_to_string({items}, ' ')"
    ratio = lambda x, y: f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0 ELSE 1.0 - levenshtein(replace({x}, 'ß', '@'), replace({y}, 'ß', '@')) / greatest(length({x}), length({y}))::DOUBLE END"
    return f"""w AS (SELECT s1_id, cand_id, {words('a')} AS x, {words('b')} AS y FROM pairs),
 t AS (SELECT s1_id, cand_id, {text('list_filter(x, lambda e: list_contains(y, e))')} AS s, trim({text('list_filter(x, lambda e: list_contains(y, e))')} || ' ' || {text('list_filter(x, lambda e: NOT list_contains(y, e))')}) AS l, trim({text('list_filter(x, lambda e: list_contains(y, e))')} || ' ' || {text('list_filter(y, lambda e: NOT list_contains(x, e))')}) AS r FROM w)
 SELECT s1_id, cand_id, round(CASE WHEN s = '' THEN {ratio('l', 'r')} ELSE greatest({ratio('s', 'l')}, {ratio('s', 'r')}, {ratio('l', 'r')}) END, 6) AS ratio FROM t"""


@query(f"WITH {_PAIRS}, {_token_set_sql()}")
def pair_token_set(spark, d):
    return _hydrated(spark, d).select("s1_id", "cand_id", r6(S.token_set_ratio(F.col("a_name_clean"), F.col("b_name_clean")), "ratio"))


_WORD_PAIRS = f"""{_PAIRS}, w AS (SELECT s1_id, cand_id, {_WORDS.format('a')} AS x, {_WORDS.format('b')} AS y FROM pairs),
 l AS (SELECT s1_id, cand_id, y, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM w), m AS (SELECT s1_id, cand_id, i, p, unnest(y) AS q FROM l),
 u AS (SELECT DISTINCT p AS a, q AS b FROM m), t AS (SELECT a, b, {_taken('a', 'b')} AS taken FROM u), j AS (SELECT a, b, {_jaro_winkler('a', 'b', 'taken')} AS jw FROM t),
 best AS (SELECT s1_id, cand_id, i, max(jw) AS jw FROM m JOIN j ON p = a AND q = b GROUP BY ALL), mean AS (SELECT s1_id, cand_id, avg(jw) AS jw FROM best GROUP BY ALL)"""


@query(f"WITH {_WORD_PAIRS} SELECT s1_id, cand_id, round(coalesce(jw, (len(x) = 0 AND len(y) = 0)::INT::DOUBLE), 9) AS similarity FROM w LEFT JOIN mean USING (s1_id, cand_id)")
def pair_monge_elkan(spark, d):
    return _hydrated(spark, d).select("s1_id", "cand_id", F.round(S.monge_elkan(F.col("a_name_clean"), F.col("b_name_clean")), 9).alias("similarity"))


_APART = "(aa = ba AND aa <> '' AND CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(replace(a, 'ß', '@'), replace(b, 'ß', '@')) / greatest(length(a), length(b))::DOUBLE END < 0.7)"
_ADDRESS_CLUSTERS = _CLUSTERS.replace("marked AS (SELECT s1_id AS u, cand_id AS v, prob, prob <= 0.3 AND NOT 1 - prob <= 0.5 AS apart FROM scored)", f"""texts AS (SELECT s.*, x.name_clean AS a, y.name_clean AS b, x.addr_clean AS aa, y.addr_clean AS ba FROM scored s JOIN canon x ON x.entity_id = s1_id JOIN canon y ON y.entity_id = cand_id),
  marked AS (SELECT s1_id AS u, cand_id AS v, prob, (prob <= 0.3 AND NOT 1 - prob <= 0.5) OR {_APART} AS apart FROM texts)""").replace("prob >= 0.82", "prob >= 0.6")


@query(f"WITH RECURSIVE {_ADDRESS_CLUSTERS} SELECT cluster_id, members FROM clusters")
def address_clusters(spark, d):
    """Clusters in which records of one address with unlike names stay apart, whatever their score."""
    pairs, records = _pairs(spark, d)
    a, b, x, y = (F.col(c) for c in ("a_name_clean", "b_name_clean", "a_addr_clean", "b_addr_clean"))
    both = features.hydrated(pairs, records, ("name_clean", "addr_clean")).withColumn("prob", S.token_jaccard(a, b))
    unlike = (x == y) & (x != "") & (S.levenshtein_ratio(a, b) < 0.7)
    labels = F.when(unlike, F.array(F.lit(0))).otherwise(calibration.prediction_set(F.col("prob"), 0.3, 0.5))
    edges = both.select(F.col("s1_id").alias("u"), F.col("cand_id").alias("v"), "prob", labels.alias("labels"))
    found = graph.constrained_clusters(biz.records(spark, d).select("entity_id"), edges, threshold=0.6)
    return found.select("cluster_id", joined(F.col("members")).alias("members"))


# -- folds and samples -------------------------------------------------------------------


@query(f"WITH {biz.BIZ}, g AS (SELECT DISTINCT source, pos % 97 AS grp FROM biz), k AS (SELECT source, grp, (row_number() OVER (PARTITION BY source ORDER BY grp) - 1) % 5 AS fold FROM g) SELECT entity_id, fold::INT AS fold FROM biz JOIN k ON k.source = biz.source AND k.grp = pos % 97")
def stratified_folds(spark, d):
    rows = biz.records(spark, d).select("entity_id", "source", (F.substring("source", 2, 1).cast("long") * 100 + F.col("pos") % 97).alias("grp"))
    return calibration.folds(rows, "grp", 5, "source", order=F.col("grp")).select("entity_id", "fold")


@query(f"WITH {biz.CANON}, {biz.TRUTH}, need AS (SELECT DISTINCT cand_id AS entity_id FROM truth), must AS (SELECT entity_id FROM pool SEMI JOIN need USING (entity_id)), rest AS (SELECT entity_id, row_number() OVER (ORDER BY pos, entity_id) AS k FROM pool ANTI JOIN need USING (entity_id)) SELECT entity_id FROM must UNION ALL SELECT entity_id FROM rest WHERE k <= 100")
def background_pool(spark, d):
    pool = biz.sides(spark, d)[1]
    needed = biz.true_links(spark, d).select(F.col("cand_id").alias("entity_id"))
    n = pool.join(needed.distinct(), "entity_id", "left_semi").count()
    return features.background(pool, needed, n + 100, order=F.col("pos")).select("entity_id")
