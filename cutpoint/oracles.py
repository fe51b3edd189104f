"""DuckDB SQL for the cut-off queries."""

from __future__ import annotations

from .queries import CANDIDATES, CUT

_LABEL = "CASE WHEN {} THEN 1 ELSE -1 END AS y"
SOURCES = {
    "noisy": "SELECT l_extendedprice::DOUBLE AS score, "
    + _LABEL.format("(l_extendedprice > 50000) <> (l_orderkey % 7 = 0)") + " FROM lineitem",
    "ties": "SELECT l_discount::DOUBLE AS score, "
    + _LABEL.format("(l_discount > 0.05) <> (l_partkey % 5 = 0)") + " FROM lineitem",
    "imbalanced": "SELECT value::DOUBLE AS score, " + _LABEL.format("value > 115") + " FROM events",
    "contrary": "SELECT value::DOUBLE AS score, " + _LABEL.format("value < 200") + " FROM events",
    "whole": "SELECT l_quantity::DOUBLE AS score, " + _LABEL.format("(l_quantity > 37) <> (l_orderkey % 7 = 0)") + " FROM lineitem",
    "words": "SELECT l_extendedprice::DOUBLE AS score, " + _LABEL.format("l_linestatus = 'O'") + " FROM lineitem",
    "docs01": "SELECT n_chars::DOUBLE AS score, " + _LABEL.format("quality = 1")
    + " FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
}

_COUNTS = """s AS MATERIALIZED ({source}),
c AS MATERIALIZED (SELECT score, count(*) FILTER (y = -1) AS neg, count(*) FILTER (y = 1) AS pos FROM s GROUP BY score),
p AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS pos, min(score) AS lo, max(score) AS hi FROM s),
k AS MATERIALIZED (SELECT score, neg, pos, lead(score) OVER (ORDER BY score) AS nxt,
  sum(neg) OVER (ORDER BY score) AS cum_neg, sum(pos) OVER (ORDER BY score) AS cum_pos,
  sum(neg) OVER (ORDER BY score) + (SELECT pos FROM p) - sum(pos) OVER (ORDER BY score) AS correct FROM c)"""
_ANSWER = "threshold, correct::BIGINT AS correct, n::BIGINT AS rows, correct::DOUBLE / n AS accuracy"


def _exact(name: str) -> str:
    return f"""WITH {_COUNTS.format(source=SOURCES[name])},
b AS (SELECT coalesce((score + nxt) / 2, score) AS t, correct FROM k ORDER BY correct DESC, score LIMIT 1),
a AS (SELECT CASE WHEN p.pos > b.correct THEN nextafter(lo, '-inf'::DOUBLE) ELSE t END AS threshold,
  greatest(p.pos, b.correct) AS correct, n FROM b, p)
SELECT {_ANSWER} FROM a"""


def _hist(name: str, bins: int) -> str:
    at = lambda x: f"least(floor(({x} - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT"
    return f"""WITH RECURSIVE s AS MATERIALIZED ({SOURCES[name]}),
p AS MATERIALIZED (SELECT count(*) AS n, count(*) FILTER (y = 1) AS pos, min(score) AS lo, max(score) AS hi FROM s),
g AS (SELECT {at("score")} AS bin, count(*) FILTER (y = -1) AS neg, count(*) FILTER (y = 1) AS pos FROM s, p GROUP BY 1),
k AS (SELECT bin, sum(neg) OVER (ORDER BY bin) + (SELECT pos FROM p) - sum(pos) OVER (ORDER BY bin) AS correct FROM g),
b AS MATERIALIZED (SELECT bin, correct FROM k ORDER BY correct DESC, bin LIMIT 1),
h AS (SELECT 0 AS i, lo AS low, hi AS high FROM p
  UNION ALL
  SELECT i + 1, CASE WHEN {at("m")} <= bin THEN m ELSE low END, CASE WHEN {at("m")} <= bin THEN high ELSE m END
  FROM (SELECT i, low, high, p.lo, p.hi, b.bin, low + (high - low) / 2 AS m FROM h, p, b
    WHERE nextafter(low, 'inf'::DOUBLE) < high)),
e AS (SELECT CASE WHEN bin >= {bins - 1} THEN hi ELSE (SELECT arg_max(low, i) FROM h) END AS edge FROM b, p),
a AS (SELECT CASE WHEN p.pos >= b.correct THEN nextafter(lo, '-inf'::DOUBLE) ELSE edge END AS threshold,
  greatest(p.pos, b.correct) AS correct, n FROM b, p, e)
SELECT {_ANSWER} FROM a"""


def _linear(name: str) -> str:
    return f"""WITH {_COUNTS.format(source=SOURCES[name])},
r AS (SELECT score, (score + lead(score) OVER (ORDER BY score)) / 2 AS threshold FROM s),
a AS (SELECT threshold, correct, n FROM r JOIN k USING (score), p WHERE threshold IS NOT NULL
  ORDER BY correct DESC, threshold LIMIT 1)
SELECT {_ANSWER} FROM a"""


def _grid_tallies(name: str) -> str:
    return f"""s AS MATERIALIZED ({SOURCES[name]}),
p AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS pos, min(score) AS lo, max(score) AS hi FROM s),
t AS (SELECT i AS pos, CASE WHEN i = 100 THEN hi WHEN i = 101 THEN nextafter(lo, '-inf'::DOUBLE)
  ELSE i * ((hi - lo) / 100) + lo END AS threshold FROM p, (SELECT unnest(range(0, 102)) AS i)),
w AS MATERIALIZED (SELECT t.pos, threshold,
  count(*) FILTER ((score > threshold) = (y = 1)) AS correct FROM t, s GROUP BY t.pos, threshold)"""


def _grid(name: str) -> str:
    return f"""WITH {_grid_tallies(name)}, a AS (SELECT threshold, correct, n FROM w, p ORDER BY correct DESC, w.pos LIMIT 1)
SELECT {_ANSWER} FROM a"""


def _descend(name: str) -> str:
    """The walk over whole counts: steps of a twentieth of the span at first, a hundredth less
    each time, turned round by a loss, until three gains in a row are under 0.001."""
    return f"""WITH RECURSIVE {_COUNTS.format(source=SOURCES[name])},
m AS MATERIALIZED (SELECT (SELECT avg(score) FROM s) AS mean, lo, hi, n FROM p),
w AS (
  SELECT 0 AS i, mean AS point, 0.05::DOUBLE * (hi - lo) AS step, 0 AS idle,
    (SELECT sum(CASE WHEN score > mean THEN pos ELSE neg END) FROM c)::BIGINT AS correct FROM m
  UNION ALL
  SELECT i + 1, point, CASE WHEN correct < last THEN -1 ELSE 1 END * least(abs(step) * (1 - 0.01::DOUBLE), (hi - lo) / 2),
    CASE WHEN abs((1 - last::DOUBLE / n) - (1 - correct::DOUBLE / n)) < 0.001 THEN idle + 1 ELSE 0 END, correct
  FROM (SELECT i, x.point, step, idle, last, lo, hi, n,
      (SELECT sum(CASE WHEN score > x.point THEN pos ELSE neg END) FROM c)::BIGINT AS correct
    FROM (SELECT i, least(greatest(point + step, lo), hi) AS point, step, idle, correct AS last, lo, hi, n FROM w, m
      WHERE i < 200 AND idle < 3) x)
),
a AS (SELECT point AS threshold, correct, n FROM w, m ORDER BY correct DESC, i LIMIT 1)
SELECT {_ANSWER} FROM a"""


def oracle_sql() -> dict[str, str]:
    """Name to SQL; searches that draw at random have none."""
    noisy, ties = SOURCES["noisy"], SOURCES["ties"]
    values = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(CANDIDATES))
    up = f"score > {CUT}"
    right = f"count(*) FILTER (({up}) = (y = 1))"
    bins = lambda x, lo, hi, n: f"least(floor(({x} - {lo}) / ({hi} - {lo}) * {n}), {n - 1})::BIGINT"
    sides = "count(*) FILTER (y = -1)::BIGINT AS neg, count(*) FILTER (y = 1)::BIGINT AS pos"
    recount = f"""WITH {_COUNTS.format(source=noisy)} SELECT any_value(n)::BIGINT AS rows,
greatest(max(correct), any_value(p.pos))::BIGINT AS ceiling, TRUE AS recounted, TRUE AS near, TRUE AS inside FROM k, p"""
    return {
        "sgrid_recount": recount,
        "sgrid_reshuffled_recount": recount,
        "genetic_recount": recount,
        "sgd_recount": recount,
        "tally_table_candidates": f"""SELECT p_partkey AS pos, p_retailprice * 50 AS threshold,
count(*) FILTER ((score > p_retailprice * 50) = (y = 1))::BIGINT AS correct FROM part, ({noisy}) s GROUP BY ALL""",
        "label_profile": f"""SELECT count(*)::BIGINT AS rows, count(*) FILTER (y = 1)::BIGINT AS positives,
count(*) FILTER (y = -1)::BIGINT AS negatives, count(*) FILTER (score IS NULL OR isnan(score))::BIGINT AS bad_scores,
0::BIGINT AS null_labels, min(score) AS lowest, max(score) AS highest FROM ({noisy})""",
        "class_counts_by_score": f"SELECT score, {sides} FROM ({ties}) GROUP BY score",
        "exact_threshold": _exact("noisy"),
        "exact_ties": _exact("ties"),
        "exact_contrary": _exact("contrary"),
        "exact_imbalanced": _exact("imbalanced"),
        "exact_string_labels": _exact("words"),
        "exact_integer_scores": _exact("docs01"),
        "exact_two_level": _exact("noisy"),
        "hist_bins": f"""WITH s AS ({noisy}), p AS (SELECT min(score) AS lo, max(score) AS hi FROM s)
SELECT {bins("score", "lo", "hi", 1024)} AS bin, {sides} FROM s, p GROUP BY 1""",
        "hist_threshold": _hist("noisy", 1024),
        "hist_threshold_16": _hist("noisy", 16),
        "hist_contrary": _hist("contrary", 1024),
        "linear_threshold": _linear("noisy"),
        "linear_ties": _linear("ties"),
        "grid_tallies": f"WITH {_grid_tallies('noisy')} SELECT pos::BIGINT AS pos, threshold, correct::BIGINT AS correct FROM w",
        "grid_threshold": _grid("noisy"),
        "tally_literal_candidates": f"""SELECT t.pos::INTEGER AS pos, threshold,
count(*) FILTER ((score > threshold) = (y = 1))::BIGINT AS correct FROM (VALUES {values}) t(pos, threshold), ({noisy}) s
GROUP BY t.pos, threshold""",
        "threshold_curve": f"""WITH {_COUNTS.format(source=ties)} SELECT score, cum_neg::BIGINT AS cum_neg,
cum_pos::BIGINT AS cum_pos, correct::BIGINT AS correct, correct::DOUBLE / n AS accuracy FROM k, p""",
        "pairwise": f"""WITH {_COUNTS.format(source=ties)} SELECT score, nxt AS next_score, (score + nxt) / 2 AS middle
FROM k WHERE nxt IS NOT NULL""",
        "confusion_at_threshold": f"""SELECT count(*) FILTER ({up} AND y = 1)::BIGINT AS tp,
count(*) FILTER ({up} AND y = -1)::BIGINT AS fp, count(*) FILTER (NOT {up} AND y = -1)::BIGINT AS tn,
count(*) FILTER (NOT {up} AND y = 1)::BIGINT AS fn FROM ({noisy})""",
        "accuracy_at_threshold": f"""SELECT count(*)::BIGINT AS rows, {right}::BIGINT AS correct,
{right}::DOUBLE / count(*) AS accuracy FROM ({noisy})""",
        "miss_ratio_at_threshold": f"""SELECT count(*)::BIGINT AS rows, {right}::BIGINT AS correct,
1 - {right}::DOUBLE / count(*) AS accuracy FROM ({noisy})""",
        "accuracy_ceiling": f"""WITH {_COUNTS.format(source=noisy)} SELECT greatest(max(correct), any_value(p.pos))::BIGINT AS correct,
greatest(max(correct), any_value(p.pos))::DOUBLE / any_value(n) AS accuracy FROM k, p""",
        "class_means": f"""SELECT round(avg(score) FILTER (y = -1), 6) AS neg_mean, round(avg(score) FILTER (y = 1), 6) AS pos_mean,
round(avg(score), 6) AS all_mean FROM ({noisy})""",
        "granularity": """SELECT (CASE WHEN x * 100 - floor(x * 100) = 0.5 AND floor(x * 100)::BIGINT % 2 = 0 THEN floor(x * 100)
  ELSE floor(x * 100 + 0.5) END / 100)::DOUBLE AS granular, count(*)::BIGINT AS rows
FROM (SELECT l_quantity::DOUBLE / 8 AS x FROM lineitem) GROUP BY 1""",
        "label_profile_gaps": """SELECT count(*)::BIGINT AS rows, count(*) FILTER (m = 0)::BIGINT AS positives,
count(*) FILTER (m IN (1, 2, 3))::BIGINT AS negatives, count(*) FILTER (score IS NULL OR isnan(score))::BIGINT AS bad_scores,
count(*) FILTER (m = 4)::BIGINT AS null_labels, min(score) FILTER (NOT isnan(score)) AS lowest,
max(score) FILTER (NOT isnan(score)) AS highest
FROM (SELECT l_partkey % 5 AS m, CASE WHEN l_orderkey % 11 = 0 THEN 'NaN'::DOUBLE
  WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END::DOUBLE AS score FROM lineitem)""",
        "map_labels": """SELECT l_linestatus AS label, CASE l_linestatus WHEN 'F' THEN -1 WHEN 'O' THEN 1 END::INTEGER AS y,
count(*)::BIGINT AS rows FROM lineitem GROUP BY 1, 2""",
        "predict": f"""SELECT y::INTEGER AS y, CASE WHEN {up} THEN 1 ELSE -1 END::INTEGER AS predicted, count(*)::BIGINT AS rows
FROM ({noisy}) GROUP BY 1, 2""",
        "unexpected_labels": "SELECT DISTINCT o_orderstatus AS label FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
        "sgrid_full_sample": _grid("noisy"),
        "sgd_full_sample": _descend("whole"),
        "exact_by_group": f"""WITH s AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS score,
{_LABEL.format("(l_extendedprice > 50000) <> (l_orderkey % 7 = 0)")} FROM lineitem),
c AS (SELECT l_returnflag, score, count(*) FILTER (y = -1) AS neg, count(*) FILTER (y = 1) AS pos FROM s GROUP BY 1, 2),
k AS (SELECT l_returnflag, score, lead(score) OVER w AS nxt, sum(pos) OVER (PARTITION BY l_returnflag) AS all_pos,
  sum(neg) OVER w + sum(pos) OVER (PARTITION BY l_returnflag) - sum(pos) OVER w AS correct FROM c
  WINDOW w AS (PARTITION BY l_returnflag ORDER BY score)),
b AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY correct DESC, score) AS r FROM k)
SELECT l_returnflag, CASE WHEN all_pos > correct THEN NULL ELSE coalesce((score + nxt) / 2, score) END AS threshold,
all_pos > correct AS all_positive, greatest(all_pos, correct)::BIGINT AS correct FROM b WHERE r = 1""",
        "stream_hist_bins": f"""SELECT {bins("greatest(0.0::DOUBLE, least(score, 110000.0::DOUBLE))", "0.0::DOUBLE", "110000.0::DOUBLE", 64)} AS bin,
{sides} FROM ({noisy}) GROUP BY 1""",
    }
