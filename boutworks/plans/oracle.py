"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

BOUTS = """e AS (SELECT user_id, ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events),
bouts AS (
  SELECT f.rn // 2 AS seq, 'all' AS league, CAST(f.user_id AS VARCHAR) AS a, CAST(s.user_id AS VARCHAR) AS b,
         CASE WHEN abs(f.value - s.value) < 1.0::DOUBLE THEN 0.5::DOUBLE WHEN f.value > s.value THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome,
         f.ts AS ts, f.value AS score_a, s.value AS score_b
  FROM e f JOIN e s ON f.rn % 2 = 0 AND s.rn = f.rn + 1 WHERE f.user_id <> s.user_id
)"""

SUPPLIER = """rev AS (SELECT l_orderkey, l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY ALL),
beside AS (SELECT *, lead(l_suppkey) OVER w AS b, lead(revenue) OVER w AS score_b FROM rev WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_suppkey)),
bouts AS (
  SELECT l_orderkey AS order_key, o_orderpriority AS league, CAST(l_suppkey AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b,
         CASE WHEN revenue = score_b THEN 0.5::DOUBLE WHEN revenue > score_b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome,
         o_orderdate AS ts, revenue AS score_a, score_b
  FROM beside JOIN orders ON o_orderkey = l_orderkey WHERE b IS NOT NULL
)"""

#: Two rows per bout, with scores and with unit scores.
SIDES = """sides AS (
  SELECT league, a AS who, b AS other, outcome AS score, score_a AS pf, score_b AS pa FROM bouts
  UNION ALL SELECT league, b, a, 1 - outcome, score_b, score_a FROM bouts
), unit AS (
  SELECT league, who, other, score, score AS pf, 1 - score AS pa FROM sides
)"""

PAIRS = """p AS (SELECT who AS u, other AS v, count(*)::DOUBLE AS g, sum(score) AS w, sum(pf - pa) AS m, sum(pf) AS pts FROM unit GROUP BY ALL),
nodes AS (SELECT u, sum(g) AS n, sum(w) AS w, sum(m) AS m FROM p GROUP BY u)"""

#: A prediction that is the same double in every engine.
HISTORY = f"""{BOUTS},
h AS (SELECT seq, a, b, ((CAST(a AS BIGINT) * 37 + CAST(b AS BIGINT) * 91 + seq * 13) % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS predicted,
             CASE outcome WHEN 1 THEN 'a' WHEN 0 THEN 'b' ELSE 'draw' END AS label FROM bouts)"""

_CELLS = """CAST(count(*) FILTER (WHERE (g = 'draw' AND label = 'draw') OR (g = 'a' AND label = 'a')) AS BIGINT) AS tp,
CAST(count(*) FILTER (WHERE (g = 'draw' AND label <> 'draw') OR (g = 'a' AND label = 'b')) AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE g = 'b' AND label = 'b') AS BIGINT) AS tn,
CAST(count(*) FILTER (WHERE (g <> 'draw' AND label = 'draw') OR (g = 'b' AND label = 'a')) AS BIGINT) AS fn"""


def guessed(lower: float, upper: float) -> str:
    return f"j AS (SELECT *, CASE WHEN predicted > {upper}::DOUBLE THEN 'a' WHEN predicted < {lower}::DOUBLE THEN 'b' ELSE 'draw' END AS g FROM h)"


def confusion(lower: float, upper: float) -> str:
    return f"WITH {HISTORY}, {guessed(lower, upper)} SELECT {_CELLS} FROM j"


METRICS = f"""WITH {HISTORY}, {guessed(0.5, 0.5)}, c AS (SELECT {_CELLS} FROM j),
r AS (SELECT *, CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + tn + fn)::DOUBLE END AS accuracy,
             CASE WHEN tp + fp = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall FROM c)
SELECT tp, fp, tn, fn, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1 FROM r"""

METRICS_DRAWS = f"""WITH {HISTORY}, {guessed(0.33, 0.66)}, c AS (
  SELECT {_CELLS}, CAST(count(*) FILTER (WHERE g = 'draw' AND label = 'draw') AS BIGINT) AS true_draw, CAST(count(*) FILTER (WHERE g = 'draw' AND label <> 'draw') AS BIGINT) AS false_draw,
         count(*) FILTER (WHERE g = label) AS hit, count(*) FILTER (WHERE label = 'draw') AS draws, count(*) AS n FROM j)
SELECT tp, fp, tn, fn, true_draw, false_draw, round(hit / n::DOUBLE, 9) AS accuracy, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall,
       round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, round(draws / n::DOUBLE, 9) AS draw_rate, round(true_draw / draws::DOUBLE, 9) AS draw_accuracy FROM c"""

REPORT = f"""WITH {HISTORY}, s AS (SELECT *, CASE WHEN predicted > 0.6::DOUBLE THEN lower(a) WHEN predicted < 0.4::DOUBLE THEN lower(b) END AS predicted_winner,
  CASE WHEN predicted > 0.6::DOUBLE THEN lower(b) WHEN predicted < 0.4::DOUBLE THEN lower(a) END AS predicted_loser, CASE WHEN label <> 'draw' THEN label END AS actual_winner FROM h)
SELECT seq, predicted_winner, predicted_loser, round(predicted * 100, 6) AS probability, actual_winner,
       predicted_winner IS NOT DISTINCT FROM (CASE actual_winner WHEN 'a' THEN lower(a) WHEN 'b' THEN lower(b) END) AS correct FROM s"""

_BIN = "CAST(least({n} - 1, greatest(0, len(list_filter([k * (1.0::DOUBLE / {n}) for k in range({n} + 1)], lambda e: e <= predicted)) - 1)) AS INTEGER)"
_Y = "CASE label WHEN 'a' THEN 1.0::DOUBLE WHEN 'draw' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
CALIBRATION = f"WITH {HISTORY} SELECT {_BIN.format(n=10)} AS bin, round(avg(predicted), 6) AS mean_predicted, round(avg({_Y}), 6) AS mean_outcome, count(*) AS n FROM h GROUP BY 1"
DENSITY = f"WITH {HISTORY} SELECT {_BIN.format(n=20)} AS bin, round(count(*) * 20 / (SELECT count(*) FROM h)::DOUBLE, 9) AS density FROM h GROUP BY 1"
LOSSES = f"""WITH {HISTORY}, v AS (SELECT predicted AS p, {_Y} AS y FROM h)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier, count(*) AS n FROM v"""
SUMMARY = f"WITH {HISTORY} SELECT min(predicted) AS low, max(predicted) AS high, round(avg(predicted), 9) AS mean, count(*) FILTER (WHERE predicted > 0.5::DOUBLE) AS above, count(*) AS n FROM h"
COHORTS = f"""WITH {HISTORY}, {guessed(0.5, 0.5)}, who AS (SELECT seq, a AS w FROM h UNION ALL SELECT seq, b FROM h),
k AS (SELECT seq, min(c) AS k FROM (SELECT seq, count(*) OVER (PARTITION BY w ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM who) GROUP BY seq),
b AS (SELECT k // 5 AS bin, count(*) FILTER (WHERE g = label) AS correct, count(*) AS total FROM j JOIN k USING (seq) GROUP BY 1)
SELECT bin, correct, total, round(correct / total::DOUBLE, 9) AS accuracy, bin * 5 AS min_bouts, bin * 5 + 4 AS max_bouts FROM b"""
SWEEP = f"""WITH {HISTORY}, g AS (SELECT predicted, count(*) FILTER (WHERE label = 'a') AS a, count(*) FILTER (WHERE label = 'b') AS b, count(*) FILTER (WHERE label = 'draw') AS d FROM h GROUP BY 1),
c AS (SELECT 0 AS k, 0 AS a, 0 AS b, 0 AS d UNION ALL SELECT row_number() OVER w, sum(a) OVER w, sum(b) OVER w, sum(d) OVER w FROM g WINDOW w AS (ORDER BY predicted)),
s AS (SELECT i.k AS i, j.k AS j, i.b - i.d + j.d - j.a + (SELECT max(a) FROM c) AS correct FROM c i JOIN c j ON j.k >= i.k)
SELECT CAST(correct AS BIGINT) AS correct, CAST(i AS BIGINT) AS below_lower, CAST(j AS BIGINT) AS below_upper FROM s ORDER BY correct DESC, i, j LIMIT 1"""

RECORDS = """SELECT league, who AS competitor, count(*) FILTER (WHERE score = 1) AS wins, count(*) FILTER (WHERE score = 0) AS losses, count(*) FILTER (WHERE score = 0.5) AS ties, count(*) AS games FROM sides GROUP BY ALL"""
HEAD_TO_HEAD = "SELECT who AS u, other AS v, count(*) AS games, sum(score) AS wins, round(sum(pf - pa), 4) AS margin, round(sum(pf), 4) AS points FROM sides GROUP BY ALL"
POINTS = "SELECT who AS competitor, round(sum(pf), 4) AS pts_for, round(sum(pa), 4) AS pts_against, round(sum(pf - pa), 4) AS margin FROM sides GROUP BY ALL"
PYTHAGOREAN_CTE = "r AS (SELECT who AS competitor, 1 / (1 + pow((sum(pa) + 1) / (sum(pf) + 1), 2.37::DOUBLE)) AS rating FROM sides GROUP BY who)"


def fold_ctes(name: str, source: str, state: str, start: str, step: str, day: bool = False) -> str:
    """``name`` (league, competitor, v): the states after a replay of ``source`` by list_reduce, league by league.

    ``step`` gives the state of a side from q.x (own), q.y (other), q.s (score) and q.t (day).
    """
    kind = f"STRUCT(i BIGINT, j BIGINT, s DOUBLE, t DOUBLE, x {state}[])"
    t = "epoch_us(ts) / 8.64e10::DOUBLE" if day else "NULL::DOUBLE"
    return f"""{name}_ids AS (SELECT league, c, row_number() OVER (PARTITION BY league ORDER BY c) AS i FROM (SELECT league, a AS c FROM {source} UNION SELECT league, b FROM {source})),
{name}_ms AS (SELECT league, any_value(sizes.n) AS n, list(CAST({{'i': p.i, 'j': q.i, 's': outcome, 't': {t}, 'x': NULL}} AS {kind}) ORDER BY seq) AS l
  FROM {source} JOIN {name}_ids p USING (league) JOIN {name}_ids q USING (league) JOIN (SELECT league, count(*) AS n FROM {name}_ids GROUP BY league) sizes USING (league) WHERE p.c = a AND q.c = b GROUP BY league),
{name}_f AS (SELECT league, list_reduce(l, lambda acc, b: CAST({{'i': b.i, 'j': b.j, 's': b.s, 't': b.t,
    'x': (list_transform([list_transform([{{'x': acc.x[b.i], 'y': acc.x[b.j], 's': b.s, 't': b.t}}, {{'x': acc.x[b.j], 'y': acc.x[b.i], 's': 1 - b.s, 't': b.t}}], lambda q: {step})],
           lambda new: list_transform(acc.x, lambda v, k: CASE WHEN k = b.i THEN new[1] WHEN k = b.j THEN new[2] ELSE v END)))[1]}} AS {kind}),
    CAST({{'i': 0, 'j': 0, 's': 0, 't': 0, 'x': list_transform(range(n), lambda _: {start})}} AS {kind})).x AS x FROM {name}_ms),
{name} AS (SELECT ids.league, c AS competitor, x[i] AS v FROM {name}_ids ids JOIN {name}_f f ON f.league = ids.league)"""


def fold(state: str, start: str, step: str, rating: str, day: bool = False) -> str:
    return f"WITH {BOUTS}, {fold_ctes('r', 'bouts', state, start, step, day)} SELECT competitor, round({rating}, 6) AS rating FROM r"


_ELO = "greatest(100.0::DOUBLE, q.x + 32 * (q.s - 1 / (1 + pow(10.0::DOUBLE, (q.y - q.x) / 400))))"
ELO = fold("DOUBLE", "400.0::DOUBLE", _ELO, "v")

_NEAR = "greatest(list_avg(q.x) - 50, least(list_avg(q.x) + 50, list_avg(q.y))) + 50 * (2 * q.s - 1)"
_ECF = f"(list_append(q.x, {_NEAR}))[-30:]"
ECF = fold("DOUBLE[]", "[100.0::DOUBLE]", _ECF, "list_avg(v)")

_DWZ_E = "1 / (1 + pow(10.0::DOUBLE, (q.y.r - q.x.r) / 400))"
_BRAKE = f"CASE WHEN q.x.r < 1300 AND q.s <= {_DWZ_E} THEN exp((1300 - q.x.r) / 150) - 1 ELSE 0.0::DOUBLE END"
_WEIGHT = f"greatest(5.0::DOUBLE, least(pow(q.x.r / 1000, 4) + 15 + ({_BRAKE}), CASE WHEN ({_BRAKE}) = 0 THEN least(30.0::DOUBLE, 5.0::DOUBLE * (q.x.n + 1)) ELSE 150.0::DOUBLE END))"
_DWZ = f"{{'r': greatest(100.0::DOUBLE, q.x.r + 800 / ({_WEIGHT} + 1) * (q.s - {_DWZ_E})), 'n': q.x.n + 1}}"
DWZ = fold("STRUCT(r DOUBLE, n BIGINT)", "{'r': 400.0::DOUBLE, 'n': 0}", _DWZ, "v.r")

_Q2 = "0.0057565::DOUBLE * 0.0057565::DOUBLE"


def _rd(side: str) -> str:
    return f"CASE WHEN q.{side}.t IS NULL THEN q.{side}.d ELSE least(350.0::DOUBLE, sqrt(q.{side}.d * q.{side}.d + 34.6::DOUBLE * 34.6::DOUBLE * (q.t - q.{side}.t))) END"


_GLICKO = f"""(list_transform([{{'r': q.x.r, 'o': q.y.r, 'd': {_rd("x")}, 'g': 1 / sqrt(1 + 3 * {_Q2} * pow({_rd("y")}, 2) / (pi() * pi())), 's': q.s, 't': q.t}}],
  lambda z: (list_transform([{{'z': z, 'e': 1 / (1 + pow(10.0::DOUBLE, -z.g * (z.r - z.o) / 400))}}],
  lambda k: {{'r': greatest(100.0::DOUBLE, k.z.r + 0.0057565::DOUBLE / (1 / (k.z.d * k.z.d) + {_Q2} * k.z.g * k.z.g * k.e * (1 - k.e)) * k.z.g * (k.z.s - k.e)),
             'd': sqrt(1 / (1 / (k.z.d * k.z.d) + {_Q2} * k.z.g * k.z.g * k.e * (1 - k.e))), 't': k.z.t}}))[1]))[1]"""
GLICKO = fold("STRUCT(r DOUBLE, d DOUBLE, t DOUBLE)", "{'r': 1500.0::DOUBLE, 'd': 350.0::DOUBLE, 't': NULL}", _GLICKO, "v.r", day=True)


# The error function by its all-positive series, of x (a hundred terms hold to |x| = 4, far beyond what the tables give); and the normal distribution's two functions of a value.
_ERF = "CASE WHEN abs(x) >= 6 THEN sign(x) ELSE 2 / sqrt(pi()) * exp(-x * x) * list_reduce([{'t': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'n': n::DOUBLE} for n in range(1, 101)], lambda e0, e1: {'t': e0.t * 2 * x * x / (2 * e1.n + 1), 's': e0.s + e0.t * 2 * x * x / (2 * e1.n + 1), 'n': e1.n}, {'t': x, 's': x, 'n': 0.0::DOUBLE}).s END"


def _cdf(z: str) -> str:
    return f"(list_transform([({z}) / sqrt(2)], lambda x: 0.5 * (1 + {_ERF})))[1]"


def _pdf(z: str) -> str:
    return f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"


def _glicko_free(x: str, xd: str, y: str, yd: str) -> str:
    """The state after a bout without waiting, from ratings and deviations."""
    return f"""(list_transform([{{'r': {x}, 'o': {y}, 'd': {xd}, 'g': 1 / sqrt(1 + 3 * {_Q2} * pow({yd}, 2) / (pi() * pi()))}}],
  lambda z: (list_transform([{{'z': z, 'e': 1 / (1 + pow(10.0::DOUBLE, -z.g * (z.r - z.o) / 400))}}],
  lambda k: {{'r': greatest(100.0::DOUBLE, k.z.r + 0.0057565::DOUBLE / (1 / (k.z.d * k.z.d) + {_Q2} * k.z.g * k.z.g * k.e * (1 - k.e)) * k.z.g * (q.s - k.e)),
             'd': sqrt(1 / (1 / (k.z.d * k.z.d) + {_Q2} * k.z.g * k.z.g * k.e * (1 - k.e)))}}))[1]))[1]"""


_ENSEMBLE = f"(list_transform([{_glicko_free('q.x.r', 'q.x.d', 'q.y.r', 'q.y.d')}], lambda g: {{'e': {_ELO.replace('q.x', 'q.x.e').replace('q.y', 'q.y.e')}, 'r': g.r, 'd': g.d}}))[1]"

_PHI = "CASE WHEN q.{0}.t IS NULL THEN q.{0}.p ELSE least(350.0::DOUBLE / 173.7178::DOUBLE, sqrt(q.{0}.p * q.{0}.p + (q.t - q.{0}.t) * q.{0}.v * q.{0}.v)) END"
_F = "(exp({x}) * (h.d2 - h.p2 - h.v - exp({x})) / (2 * (h.p2 + h.v + exp({x})) * (h.p2 + h.v + exp({x}))) - ({x} - h.a) / 0.25::DOUBLE)"


def _glicko2() -> str:
    """Glickman's second system: the volatility is the root of f, found by bracketing and the Illinois method."""
    f = lambda x: _F.format(x=x)
    start = "{'m': q.x.m, 's': q.x.v, 'p': " + _PHI.format("x") + ", 'j': q.y.m, 'g': 1 / sqrt(1 + 3 * pow(" + _PHI.format("y") + ", 2) / (pi() * pi()))}"
    chance = "{'k': k, 'e': 1 / (1 + exp(-k.g * (k.m - k.j)))}"
    var = "{'k': e.k, 'e': e.e, 'v': 1 / (e.k.g * e.k.g * e.e * (1 - e.e)), 'n': e.k.g * (q.s - e.e)}"
    known = "{'k': w.k, 'v': w.v, 'n': w.n, 'p2': w.k.p * w.k.p, 'd2': w.v * w.n * w.v * w.n, 'a': ln(w.k.s * w.k.s)}"
    high = f"CASE WHEN h.d2 > h.p2 + h.v THEN ln(h.d2 - h.p2 - h.v) ELSE h.a - 0.5::DOUBLE * list_min(list_filter(range(1, 201), lambda n: n = 200 OR {f('(h.a - n * 0.5::DOUBLE)')} >= 0)) END"
    ends = f"{{'h': h, 'b': {high}}}"
    mid = "(z.lo + (z.lo - z.hi) * z.fl / (z.fh - z.fl))"
    loop = f"""list_reduce([{{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE, 'fl': 0.0::DOUBLE, 'fh': 0.0::DOUBLE}} for _ in range(20)],
      lambda z, _: CASE WHEN abs(z.hi - z.lo) <= 1e-6::DOUBLE THEN z ELSE (list_transform([{{'m': {mid}, 'f': (list_transform([{mid}], lambda m: {f('m')}))[1]}}],
        lambda c: {{'lo': CASE WHEN c.f * z.fh < 0 THEN z.hi ELSE z.lo END, 'hi': c.m, 'fl': CASE WHEN c.f * z.fh < 0 THEN z.fh ELSE z.fl / 2 END, 'fh': c.f}}))[1] END,
      {{'lo': h.a, 'hi': y.b, 'fl': {f('h.a')}, 'fh': {f('y.b')}}})"""
    sigma = f"(list_transform([y.h], lambda h: exp(({loop}).lo / 2)))[1]"
    last = "{'m': u.h.k.m + u.h.n / (1 / (u.h.k.p * u.h.k.p + u.s * u.s) + 1 / u.h.v), 'p': 1 / sqrt(1 / (u.h.k.p * u.h.k.p + u.s * u.s) + 1 / u.h.v), 'v': u.s, 't': q.t}"
    out = f"(list_transform([{start}], lambda k: {chance}))[1]"
    for var_, expr in (("e", var), ("w", known), ("h", ends), ("y", f"{{'h': y.h, 's': {sigma}}}")):
        out = f"(list_transform([{out}], lambda {var_}: {expr}))[1]"
    # phi' = 1 / sqrt(1 / (phi^2 + sigma'^2) + 1 / v), mu' = mu + phi'^2 * gain
    last = last.replace("1 / (u.h.k.p * u.h.k.p + u.s * u.s) + 1 / u.h.v", "1 / (u.h.k.p * u.h.k.p + u.s * u.s) + 1 / u.h.v")
    return f"(list_transform([{out}], lambda u: {last}))[1]"


_GLICKO2 = _glicko2()

_MARGIN = "(sqrt(2) * 4.166::DOUBLE * 0.12566134685507402::DOUBLE)"


def _trueskill() -> str:
    """A side's new mean and deviation; the loser's shift is the winner's with the sign turned."""
    start = "{'m': q.x.m, 'd': q.x.m - q.y.m, 'a': q.x.s * q.x.s + 0.083::DOUBLE * 0.083::DOUBLE, 'b': q.y.s * q.y.s + 0.083::DOUBLE * 0.083::DOUBLE}"
    total = "{'k': k, 'c': sqrt(2 * 4.166::DOUBLE * 4.166::DOUBLE + k.a + k.b)}"
    turn = "CASE WHEN q.s = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    t = f"{{'k': c.k, 'c': c.c, 'u': {turn}, 't': CASE WHEN q.s = 0.5 THEN c.k.d / c.c ELSE ({turn} * c.k.d - {_MARGIN}) / c.c END, 'e': {_MARGIN} / c.c}}"
    below = f"{{'z': z, 'w': CASE WHEN q.s = 0.5 THEN {_cdf('z.t + z.e')} - {_cdf('z.t - z.e')} ELSE {_cdf('z.t')} END, 'lo': {_pdf('z.t - z.e')}, 'hi': {_pdf('z.t + z.e')}, 'p': {_pdf('z.t')}}}"
    shift = "{'z': w.z, 'w': w.w, 'lo': w.lo, 'hi': w.hi, 'v': CASE WHEN w.w <= 0 THEN 0.0::DOUBLE WHEN q.s = 0.5 THEN (w.lo - w.hi) / w.w ELSE w.p / w.w END}"
    shrink = "{'z': v.z, 'v': v.v, 'h': CASE WHEN q.s <> 0.5 THEN v.v * (v.v + v.z.t) WHEN v.w <= 0 THEN 0.0::DOUBLE ELSE v.v * v.v + ((v.z.e - v.z.t) * v.lo + (v.z.e + v.z.t) * v.hi) / v.w END}"
    last = "{'m': h.z.k.m + h.z.k.a / h.z.c * CASE WHEN q.s = 0.5 THEN -h.v ELSE h.z.u * h.v END, 's': sqrt(h.z.k.a * (1 - h.z.k.a / (h.z.c * h.z.c) * h.h))}"
    out = f"(list_transform([{start}], lambda k: {total}))[1]"
    for name, expr in (("c", t), ("z", below), ("w", shift), ("v", shrink), ("h", last)):
        out = f"(list_transform([{out}], lambda {name}: {expr}))[1]"
    return out


_TRUESKILL = _trueskill()

#: By system: state, a newcomer's state, step, whether times count, rating of v, and the chance of v against w.
FOLDS = {
    "elo": ("DOUBLE", "400.0::DOUBLE", _ELO, False, "v", "1 / (1 + pow(10.0::DOUBLE, (w - v) / 400))"),
    "glicko": ("STRUCT(r DOUBLE, d DOUBLE, t DOUBLE)", "{'r': 1500.0::DOUBLE, 'd': 350.0::DOUBLE, 't': NULL}", _GLICKO, True, "v.r", f"1 / (1 + pow(10.0::DOUBLE, -(v.r - w.r) / 400 / sqrt(1 + 3 * {_Q2} * w.d * w.d / (pi() * pi()))))"),
    "glicko2": ("STRUCT(m DOUBLE, p DOUBLE, v DOUBLE, t DOUBLE)", "{'m': 0.0::DOUBLE, 'p': 350.0::DOUBLE / 173.7178::DOUBLE, 'v': 0.06::DOUBLE, 't': NULL}", _GLICKO2, True, "greatest(100.0::DOUBLE, v.m * 173.7178::DOUBLE + 1500)", "1 / (1 + exp(-(v.m - w.m) / sqrt(1 + 3 * w.p * w.p / (pi() * pi()))))"),
    "trueskill": ("STRUCT(m DOUBLE, s DOUBLE)", "{'m': 25.0::DOUBLE, 's': 8.333::DOUBLE}", _TRUESKILL, False, "v.m - 3 * v.s",
                  f"({_cdf(f'(v.m - w.m - {_MARGIN}) / sqrt(2 * 4.166::DOUBLE * 4.166::DOUBLE + v.s * v.s + w.s * w.s)')} + {_cdf(f'(v.m - w.m + {_MARGIN}) / sqrt(2 * 4.166::DOUBLE * 4.166::DOUBLE + v.s * v.s + w.s * w.s)')}) / 2"),
    "ecf": ("DOUBLE[]", "[100.0::DOUBLE]", _ECF, False, "list_avg(v)", "1 / (1 + pow(10.0::DOUBLE, (list_avg(w) - list_avg(v)) * 7.5 / 400))"),
    "dwz": ("STRUCT(r DOUBLE, n BIGINT)", "{'r': 400.0::DOUBLE, 'n': 0}", _DWZ, False, "v.r", "1 / (1 + pow(10.0::DOUBLE, (w.r - v.r) / 400))"),
    "ensemble": ("STRUCT(e DOUBLE, r DOUBLE, d DOUBLE)", "{'e': 400.0::DOUBLE, 'r': 1500.0::DOUBLE, 'd': 350.0::DOUBLE}", _ENSEMBLE, False, "v.e + v.r",
                 f"(1 / (1 + pow(10.0::DOUBLE, (w.e - v.e) / 400)) + 1 / (1 + pow(10.0::DOUBLE, -(v.r - w.r) / 400 / sqrt(1 + 3 * {_Q2} * w.d * w.d / (pi() * pi()))))) / 2"),
}
GLICKO2, TRUESKILL, ENSEMBLE = (fold(*FOLDS[k][:3], FOLDS[k][4], FOLDS[k][3]) for k in ("glicko2", "trueskill", "ensemble"))

_SPLIT = """ranked AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS k, count(*) OVER () AS n FROM bouts),
train AS (SELECT * FROM ranked WHERE k < floor(n * (1 - 0.3::DOUBLE))), held AS (SELECT * FROM ranked WHERE k >= floor(n * (1 - 0.3::DOUBLE)))"""


#: Two rows per training bout, by scores; pairs and nodes of them.
_TRAIN = """t_sides AS (SELECT a AS who, b AS other, outcome AS s, score_a AS pf, score_b AS pa FROM train UNION ALL SELECT b, a, 1 - outcome, score_b, score_a FROM train),
t_p AS (SELECT who AS u, other AS v, count(*)::DOUBLE AS g, sum(s) AS w, sum(pf - pa) AS m, sum(pf) AS pts FROM t_sides GROUP BY ALL),
t_nodes AS (SELECT u, sum(g) AS n, sum(w) AS w, sum(m) AS m FROM t_p GROUP BY u)"""


def _steps(name: str, start: str, step: str, norm: str, steps: int, term: str, pairs: str = "t_p") -> str:
    """``i_name`` (k, u, x): fixed-point iteration over the training pairs."""
    return f"""i_{name} AS (
  SELECT 0 AS k, u, {start}::DOUBLE AS x FROM t_nodes
  UNION ALL
  SELECT k, u, {norm} FROM (
    SELECT any_value(r.k) + 1 AS k, n.u, {step.replace("TERM", f"sum({term})")} AS z
    FROM i_{name} r JOIN {pairs} p ON p.v = r.u JOIN t_nodes n ON n.u = p.u JOIN i_{name} mine ON mine.u = p.u WHERE r.k < {steps} GROUP BY n.u)
)"""


#: By fit: the iteration, the table of (competitor, v), and the chance of v against w.
FIT_SQL = {
    "pythagorean": ("", "SELECT who AS competitor, 1 / (1 + pow((sum(pa) + 1) / (sum(pf) + 1), 2.37::DOUBLE)) AS v FROM t_sides GROUP BY who",
                    "CASE WHEN v >= w THEN v * (1 - w) / (v * (1 - w) + w * (1 - v)) ELSE 1 - w * (1 - v) / (w * (1 - v) + v * (1 - w)) END"),
    "colley": (_steps("colley", "0.5", "(1 + (2 * any_value(n.w) - any_value(n.n)) / 2 + TERM) / (2 + any_value(n.n))", "z", 1000, "p.g * r.x"),
               "SELECT u AS competitor, x AS v FROM i_colley WHERE k = 1000", "1 / (1 + exp(-4 * (v - w)))"),
    "massey": (_steps("massey", "0.0", "0.5 * any_value(mine.x) + 0.5 * (any_value(n.m) + TERM) / any_value(n.n)", "z - avg(z) OVER ()", 400, "p.g * r.x"),
               "SELECT u AS competitor, x AS v FROM i_massey WHERE k = 400", "0.5 * (1 + tanh((v - w) / (SELECT greatest(sqrt(2) * stddev_pop(v), 1e-9::DOUBLE) FROM r_massey)))"),
    "keener": ("t_liked AS (SELECT x.u, x.v, 0.5 + 0.5 * sign(c) * sqrt(abs(c)) AS g FROM (SELECT x.u, x.v, 2 * (x.pts + 1) / (x.pts + y.pts + 2) - 1 AS c FROM t_p x JOIN t_p y ON y.u = x.v AND y.v = x.u) x),\n"
               + _steps("keener", "1.0", "TERM / (any_value(n.n) + 2) + 0.0001::DOUBLE * (SELECT count(*) FROM t_nodes)", "z / avg(z) OVER ()", 100, "p.g * r.x", "t_liked"),
               "SELECT u AS competitor, x AS v FROM i_keener WHERE k = 100", "v / (v + w)"),
    "bradley_terry": (_steps("bradley_terry", "1.0", "(any_value(n.w) + 0.1::DOUBLE) / (TERM + 0.2::DOUBLE / (any_value(mine.x) + 1))", "z / exp(avg(ln(z)) OVER ())", 300, "p.g / (mine.x + r.x)"),
                      "SELECT u AS competitor, ln(x) AS v FROM i_bradley_terry WHERE k = 300", "1 / (1 + exp(-(v - w)))"),
}


def _judged(name: str) -> str:
    """``h_name``: the held-out bouts of known competitors with predictions, and ``o_name``: counts and the best cuts."""
    if name in FIT_SQL:
        steps, rated, chance = FIT_SQL[name]
        ctes = (steps + ",\n" if steps else "") + f"r_{name} AS ({rated})"
    else:
        state, start, step, day, _, chance = FOLDS[name]
        ctes = fold_ctes("r_" + name, "train", state, start, step, day)
    return f"""{ctes},
h_{name} AS (SELECT seq, a, b, CASE outcome WHEN 1 THEN 'a' WHEN 0 THEN 'b' ELSE 'draw' END AS label, {chance} AS predicted
  FROM (SELECT held.*, x.v AS v, y.v AS w FROM held JOIN r_{name} x ON x.competitor = a JOIN r_{name} y ON y.competitor = b)),
c_{name} AS (SELECT 0 AS k, 0 AS a, 0 AS b, 0 AS d UNION ALL SELECT row_number() OVER u, sum(a) OVER u, sum(b) OVER u, sum(d) OVER u
  FROM (SELECT predicted, count(*) FILTER (WHERE label = 'a') AS a, count(*) FILTER (WHERE label = 'b') AS b, count(*) FILTER (WHERE label = 'draw') AS d FROM h_{name} GROUP BY 1) WINDOW u AS (ORDER BY predicted)),
o_{name} AS (SELECT max(i.b - i.d + j.d - j.a + (SELECT max(a) FROM c_{name})) / (SELECT count(*) FROM h_{name})::DOUBLE AS accuracy_opt FROM c_{name} i JOIN c_{name} j ON j.k >= i.k),
m_{name} AS (SELECT '{name}' AS system, {_CELLS}, count(*) AS n FROM (SELECT *, CASE WHEN predicted > 0.5::DOUBLE THEN 'a' WHEN predicted < 0.5::DOUBLE THEN 'b' ELSE 'draw' END AS g FROM h_{name}))"""


def evaluated(names: list[str], columns: str) -> str:
    whole = " UNION ALL ".join(f"SELECT * FROM m_{n}, o_{n}" for n in names)
    return f"""WITH RECURSIVE {BOUTS}, {_SPLIT}, {_TRAIN}, {", ".join(map(_judged, names))}, every AS ({whole}),
p AS (SELECT *, (tp + tn) / n::DOUBLE AS accuracy_, CASE WHEN tp + fp = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS p_, CASE WHEN tp + fn = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS r_ FROM every),
judged AS (SELECT system, n, tp, fp, tn, fn, round(accuracy_, 9) AS accuracy, round(p_, 9) AS precision, round(r_, 9) AS recall, round(2 * p_ * r_ / (p_ + r_), 9) AS f1,
                  round(accuracy_opt, 9) AS accuracy_opt, round(accuracy_opt, 9) AS optimized_accuracy FROM p)
SELECT {columns} FROM judged"""


EVALUATE = evaluated(["elo"], "n, tp, fp, tn, fn, accuracy, precision, recall, f1")
BENCHMARK = evaluated([*FOLDS, *FIT_SQL], "system, n, tp, fp, tn, fn, accuracy, precision, recall, f1, accuracy_opt")
COMPARISON = evaluated(["elo", "dwz"], "system, accuracy, precision, recall, f1, accuracy_opt, optimized_accuracy")
EVALUATION_REPORT = f"""WITH {BOUTS}, {_SPLIT}, {_judged("elo")},
top AS (SELECT competitor, row_number() OVER (ORDER BY rating DESC, competitor) AS place FROM (SELECT competitor, round(v, 6) AS rating FROM r_elo) QUALIFY place <= 5),
past AS (SELECT c, count(*) AS n FROM (SELECT a AS c FROM train UNION ALL SELECT b FROM train) GROUP BY c),
who AS (SELECT seq, a AS c FROM h_elo UNION ALL SELECT seq, b FROM h_elo),
k AS (SELECT seq, min(before + coalesce(n, 0)) AS k FROM (SELECT seq, c, count(*) OVER (PARTITION BY c ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM who) LEFT JOIN past USING (c) GROUP BY seq),
bins AS (SELECT k // 5 AS bin, count(*) FILTER (WHERE (CASE WHEN predicted > 0.5::DOUBLE THEN 'a' WHEN predicted < 0.5::DOUBLE THEN 'b' ELSE 'draw' END) = label) AS correct, count(*) AS total FROM h_elo JOIN k USING (seq) GROUP BY 1)
SELECT 'top' AS kind, place AS at, competitor, 0::BIGINT AS correct, 0::BIGINT AS total FROM top UNION ALL SELECT 'cohort', bin, '', correct, total FROM bins"""

ELO_BY_LEAGUE = f"""WITH {SUPPLIER.replace("bouts AS", "unnumbered AS")}, bouts AS (SELECT *, row_number() OVER (ORDER BY ts, order_key, a, b) - 1 AS seq FROM unnumbered), {SIDES},
{fold_ctes("r", "bouts", *FOLDS["elo"][:3])}, g AS (SELECT league, who AS competitor, count(*) AS games FROM sides GROUP BY ALL)
SELECT r.league, r.competitor, round(v, 6) AS rating, games FROM r JOIN g ON g.league = r.league AND g.competitor = r.competitor"""

RANDOM_SEARCH = f"""WITH {HISTORY}, ends AS (SELECT min(predicted) AS low, max(predicted) AS high FROM h),
drawn AS (SELECT trial, low + (high - low) * (('0x' || md5(trial || ':x:0')[1:8])::BIGINT / 4294967296.0::DOUBLE) AS x, low + (high - low) * (('0x' || md5(trial || ':y:0')[1:8])::BIGINT / 4294967296.0::DOUBLE) AS y FROM range(1000) t(trial), ends),
scored AS (SELECT trial, least(x, y) AS lower, greatest(x, y) AS upper,
             (SELECT count(*) FROM h WHERE CASE WHEN predicted > greatest(x, y) THEN 'a' WHEN predicted < least(x, y) THEN 'b' ELSE 'draw' END = label) AS correct FROM drawn)
SELECT trial, round(lower, 9) AS lower, round(upper, 9) AS upper, correct FROM scored ORDER BY correct DESC, trial LIMIT 1"""


def _uniform(seed: int, key: str) -> str:
    return f"((('0x' || md5('{seed}:' || {key})[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


def _normal(seed: int, key: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(seed, key)})) * cos(2 * pi() * {_uniform(seed + 1, key)}))"


SYNTHETIC = f"""WITH who AS (SELECT id, 'competitor_' || id AS competitor, 1500.0::DOUBLE + 300.0::DOUBLE * {_normal(42, "id")} AS skill FROM range(50) t(id)),
picks AS (SELECT seq, CAST(floor({_uniform(52, "seq")} * 50) AS BIGINT) AS i FROM range(2000) t(seq)),
rows_ AS (SELECT seq, i, (i + 1 + CAST(floor({_uniform(53, "seq")} * 49) AS BIGINT)) % 50 AS j FROM picks),
met AS (SELECT seq, x.competitor AS a, y.competitor AS b, x.skill - y.skill AS diff, x.skill - y.skill + 100.0::DOUBLE * {_normal(54, "seq")} AS apart FROM rows_ JOIN who x ON x.id = i JOIN who y ON y.id = j)
SELECT seq, a, b, CASE WHEN abs(apart) < 100 AND {_uniform(56, "seq")} < 0.1::DOUBLE THEN 0.5::DOUBLE WHEN apart > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome, round(diff, 6) AS skill_diff FROM met"""

ELO_HISTORY = f"""WITH RECURSIVE {BOUTS}, ids AS (SELECT c, row_number() OVER (ORDER BY c) AS i FROM (SELECT a AS c FROM bouts UNION SELECT b FROM bouts)),
ms AS (SELECT list(CAST({{'i': p.i, 'j': q.i, 's': outcome, 'x': NULL, 'p': NULL}} AS STRUCT(i BIGINT, j BIGINT, s DOUBLE, x DOUBLE[], p DOUBLE[])) ORDER BY seq) AS l, list(seq ORDER BY seq) AS seqs FROM bouts JOIN ids p ON p.c = a JOIN ids q ON q.c = b),
f AS (SELECT seqs, list_reduce(l, lambda acc, b: {{'i': b.i, 'j': b.j, 's': b.s,
    'x': list_transform(acc.x, lambda v, k: CASE WHEN k = b.i THEN greatest(100.0::DOUBLE, v + 32 * (b.s - 1 / (1 + pow(10.0::DOUBLE, (acc.x[b.j] - v) / 400))))
                                                 WHEN k = b.j THEN greatest(100.0::DOUBLE, v + 32 * (1 - b.s - 1 / (1 + pow(10.0::DOUBLE, (acc.x[b.i] - v) / 400)))) ELSE v END),
    'p': list_append(acc.p, 1 / (1 + pow(10.0::DOUBLE, (acc.x[b.j] - acc.x[b.i]) / 400)))}},
    CAST({{'i': 0, 'j': 0, 's': 0, 'x': [400.0::DOUBLE for _ in range((SELECT count(*) FROM ids))], 'p': []}} AS STRUCT(i BIGINT, j BIGINT, s DOUBLE, x DOUBLE[], p DOUBLE[]))).p AS p FROM ms)
SELECT seq, a, b, round(p, 9) AS predicted, outcome FROM (SELECT unnest(seqs) AS seq, unnest(p) AS p FROM f) JOIN bouts USING (seq)"""


def iterate(start: str, step: str, norm: str, rating: str, steps: int, digits: int, both: bool = False) -> str:
    """Fixed-point iteration over the pairs: ``step`` from n (node) and s (sum over neighbours), then ``norm``."""
    term = "p.g / (mine.x + r.x)" if both else "p.g * r.x"
    return f"""WITH RECURSIVE {BOUTS}, {SIDES}, {PAIRS},
r AS (
  SELECT 0 AS k, u, {start}::DOUBLE AS x FROM nodes
  UNION ALL
  SELECT k, u, {norm} FROM (
    SELECT any_value(r.k) + 1 AS k, n.u, {step} AS z, any_value(mine.x) AS old, any_value(n.n) AS n
    FROM r JOIN p ON p.v = r.u JOIN nodes n ON n.u = p.u JOIN r mine ON mine.u = p.u WHERE r.k < {steps} GROUP BY n.u)
)
SELECT u AS competitor, round({rating}, {digits}) AS rating FROM r WHERE k = {steps}""".replace("TERM", f"sum({term})")


COLLEY = iterate("0.5", "(1 + (2 * any_value(n.w) - any_value(n.n)) / 2 + TERM) / (2 + any_value(n.n))", "z", "x", 1000, 9)
MASSEY = iterate("0.0", "0.5 * any_value(mine.x) + 0.5 * (any_value(n.m) + TERM) / any_value(n.n)", "z - avg(z) OVER ()", "x", 400, 9)
BRADLEY_TERRY = iterate("1.0", "(any_value(n.w) + 0.1::DOUBLE) / (TERM + 0.2::DOUBLE / (any_value(mine.x) + 1))", "z / exp(avg(ln(z)) OVER ())", "ln(x)", 300, 7, both=True)
KEENER = f"""WITH RECURSIVE {BOUTS}, {SIDES}, {PAIRS},
liked AS (SELECT x.u, x.v, 0.5 + 0.5 * sign(c) * sqrt(abs(c)) AS l FROM (SELECT x.u, x.v, 2 * (x.pts + 1) / (x.pts + y.pts + 2) - 1 AS c FROM p x JOIN p y ON y.u = x.v AND y.v = x.u) x),
r AS (
  SELECT 0 AS k, u, 1.0::DOUBLE AS x, (SELECT count(*) FROM nodes)::DOUBLE AS total FROM nodes
  UNION ALL
  SELECT k, u, z / avg(z) OVER (), total FROM (
    SELECT any_value(r.k) + 1 AS k, n.u, sum(l * r.x) / (any_value(n.n) + 2) + 0.0001::DOUBLE * any_value(r.total) AS z, any_value(r.total) AS total
    FROM r JOIN liked ON liked.v = r.u JOIN nodes n ON n.u = liked.u WHERE r.k < 100 GROUP BY n.u)
)
SELECT u AS competitor, round(x, 6) AS rating FROM r WHERE k = 100"""



def trueskill(margin: float) -> str:
    beta2 = "2 * 4.166::DOUBLE * 4.166::DOUBLE"
    return f"""WITH {BOUTS}, m AS (SELECT seq, 20 + CAST(a AS BIGINT) % 11 AS ma, 4 + CAST(a AS BIGINT) % 5 AS sa, 20 + CAST(b AS BIGINT) % 11 AS mb, 4 + CAST(b AS BIGINT) % 5 AS sb FROM bouts),
v AS (SELECT seq, (ma - mb)::DOUBLE AS d, sqrt({beta2} + sa * sa + sb * sb) AS v, {beta2} + sa * sa + sb * sb AS c2 FROM m),
z AS (SELECT seq, d, c2, (d - {margin!r}::DOUBLE) / v / sqrt(2) AS lo, (d + {margin!r}::DOUBLE) / v / sqrt(2) AS hi FROM v),
f AS (SELECT seq, d, c2, (SELECT 0.5 * (1 + {_ERF}) FROM (SELECT lo AS x)) AS win, (SELECT 0.5 * (1 + {_ERF}) FROM (SELECT hi AS x)) AS held FROM z)
SELECT seq, round(win + (held - win) / 2, 9) AS expected, round(sqrt({beta2} / c2) * exp(-d * d / (2 * c2)), 9) AS quality FROM f"""


RATED = f"{BOUTS}, {SIDES}, {PYTHAGOREAN_CTE}, g AS (SELECT who AS competitor, count(*) AS games FROM sides GROUP BY who), rated AS (SELECT competitor, round(rating * 1000, 3) AS rating, 30.0::DOUBLE + games AS spread, games FROM r JOIN g USING (competitor))"
EXPECTED_GRID = f"""WITH {RATED}, q AS (SELECT seq, x.rating / 10 AS ra, y.rating / 10 AS rb, x.spread AS da, y.spread AS db FROM bouts JOIN rated x ON x.competitor = a JOIN rated y ON y.competitor = b)
SELECT seq, round(1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400)), 9) AS elo, round(1 / (1 + pow(10.0::DOUBLE, (rb * 7.5 - ra * 7.5) / 400)), 9) AS ecf,
       round(1 / (1 + pow(10.0::DOUBLE, -(1 / sqrt(1 + 3 * {_Q2} * db * db / (pi() * pi()))) * (ra - rb) / 400)), 9) AS glicko,
       round(1 / (1 + exp(-(ra - rb) / 100 / sqrt(1 + 3 * (db / 100) * (db / 100) / (pi() * pi())))), 9) AS glicko2,
       round(1 / (1 + exp(-4 * (ra - rb) / 100)), 9) AS colley, round(0.5 * (1 + tanh((ra - rb) / 25)), 9) AS massey,
       round(0.5 * (1 + tanh(0.5 * (ln(ra) - ln(rb)))), 9) AS keener, round(1 / (1 + exp(-(ra - rb) / 100)), 9) AS bradley_terry,
       round(1 / (1 + exp(-(ra - rb) * ln(10) / 400)), 9) AS whole_history FROM q"""
LOG5 = f"""WITH {BOUTS}, {SIDES}, {PYTHAGOREAN_CTE}
SELECT seq, round(x.rating * (1 - y.rating) / (x.rating * (1 - y.rating) + y.rating * (1 - x.rating)), 9) AS expected FROM bouts JOIN r x ON x.competitor = a JOIN r y ON y.competitor = b"""
ENSEMBLE_MEAN = f"""WITH {RATED}, q AS (SELECT seq, x.rating AS ra, y.rating AS rb FROM bouts JOIN rated x ON x.competitor = a JOIN rated y ON y.competitor = b)
SELECT seq, round((1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400)) + 1 / (1 + exp(-4 * (ra - rb) / 1000))) / 2, 9) AS expected, round(ra + ra / 1000 + rb + rb / 1000, 6) AS rating_sum FROM q"""
NEAREST = f"""WITH {RATED} SELECT competitor, opponent, round(diff, 6) AS diff FROM (
  SELECT x.competitor, y.competitor AS opponent, abs(x.rating - y.rating) AS diff, row_number() OVER (PARTITION BY x.competitor ORDER BY abs(x.rating - y.rating), y.competitor) AS k
  FROM rated x JOIN rated y ON x.competitor <> y.competitor AND abs(x.rating - y.rating) <= 100) WHERE k = 1"""
DEVIATION = f"""WITH {RATED} SELECT competitor, opponent, round(quality, 6) AS quality FROM (
  SELECT competitor, opponent, quality, row_number() OVER (PARTITION BY competitor ORDER BY quality, opponent) AS k FROM (
    SELECT x.competitor, y.competitor AS opponent, abs(x.rating - y.rating) / (1 + sqrt(x.spread * x.spread + y.spread * y.spread) / 100) AS quality
    FROM rated x JOIN rated y ON x.competitor <> y.competitor AND abs(x.rating - y.rating) <= 100)) WHERE k = 1"""
CLOSEST = f"""WITH {RATED} SELECT a, b, round(gap, 6) AS gap FROM (SELECT competitor AS a, lead(competitor) OVER w AS b, lead(rating) OVER w - rating AS gap FROM rated WINDOW w AS (ORDER BY rating, competitor)) WHERE b IS NOT NULL ORDER BY gap, a LIMIT 1"""
TEAMS = f"""WITH {RATED} SELECT CAST(competitor AS BIGINT) % 10 AS team, round(sum(rating), 4) AS mu, round(sqrt(sum(spread * spread)), 4) AS sigma, round(avg(rating), 4) AS mean FROM rated GROUP BY 1"""
TOP = f"WITH {RATED} SELECT competitor, rating, row_number() OVER (ORDER BY rating DESC, competitor) AS place FROM rated ORDER BY place LIMIT 10"
MIN_GAMES = f"WITH {RATED} SELECT competitor, rating, games FROM rated WHERE games >= (SELECT avg(games) FROM rated)"
ASOF = f"""WITH {RATED}, curve AS (SELECT who AS competitor, ts::DATE AS day, max(round(pf, 3)) AS rating FROM (SELECT a AS who, ts, score_a AS pf FROM bouts UNION ALL SELECT b, ts, score_b FROM bouts) GROUP BY ALL),
wanted AS (SELECT DISTINCT competitor, DATE '2024-01-10' AS day FROM rated UNION ALL SELECT DISTINCT competitor, DATE '2023-12-31' FROM rated)
SELECT competitor, day, coalesce((SELECT max_by(c.rating, c.day) FROM curve c WHERE c.competitor = w.competitor AND c.day <= w.day), 1500.0::DOUBLE) AS rating FROM wanted w"""
RUNNING = f"""WITH {BOUTS} SELECT seq, who, count(*) OVER (PARTITION BY who ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM (SELECT seq, a AS who FROM bouts UNION ALL SELECT seq, b FROM bouts)"""
TIME_SPLIT = f"""WITH {BOUTS}, n AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS k, count(*) OVER () AS n FROM bouts)
SELECT CASE WHEN k < floor(n * (1 - 0.3::DOUBLE)) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(seq) AS first, max(seq) AS last FROM n GROUP BY 1"""
RANDOM_SPLIT = f"""WITH {BOUTS}, n AS (SELECT *, row_number() OVER (ORDER BY md5(seq || ':7'), seq) - 1 AS k, count(*) OVER () AS n FROM bouts)
SELECT seq, CASE WHEN k < floor(n * (1 - 0.3::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM n"""
COMPETITOR_SPLIT = f"""WITH {BOUTS}, w AS (SELECT who, row_number() OVER (ORDER BY md5(who || ':7'), who) - 1 AS k, count(*) OVER () AS n FROM (SELECT a AS who FROM bouts UNION SELECT b FROM bouts)),
held AS (SELECT who FROM w WHERE k >= floor(n * (1 - 0.2::DOUBLE)))
SELECT seq, CASE WHEN a IN (SELECT who FROM held) OR b IN (SELECT who FROM held) THEN 'test' ELSE 'train' END AS split FROM bouts"""
LABELS = """SELECT event_id, CASE WHEN o IN ('win', 'yes', '1', 't') THEN 'a' WHEN o IN ('loss', 'no', '0', 'f') THEN 'b' WHEN o IN ('draw', 'tie', '0.5', 'eq') THEN 'draw' END AS label
FROM (SELECT event_id, lower(['WIN', 'Loss', 'tie', 'yes', 'No', '0.5', '1', '0', 'unknown', 'T', 'f', 'eq', 'draw'][event_id % 13 + 1]) AS o FROM events)"""
SCORES_OK = f"WITH {BOUTS} SELECT seq, sign(score_a - score_b) = sign(outcome - 0.5) AND score_a >= 0 AND score_b >= 0 AS ok FROM bouts"
STRICT = f"""WITH {HISTORY}, o AS (SELECT h.*, outcome FROM h JOIN bouts USING (seq))
SELECT seq, predicted > 0.5::DOUBLE AND outcome = 1 AS true_positive, predicted > 0.5::DOUBLE AND outcome <> 1 AS false_positive,
       predicted <= 0.5::DOUBLE AND outcome = 0 AS true_negative, predicted <= 0.5::DOUBLE AND outcome <> 0 AS false_negative FROM o"""
PRIOR_LINE = f"WITH c AS ({COHORTS}) SELECT (min_bouts + max_bouts) // 2 AS x, accuracy AS y, total AS n FROM c"
ROUND_ROBIN = f"WITH {BOUTS}, w AS (SELECT a AS c FROM bouts UNION SELECT b FROM bouts) SELECT x.c AS a, y.c AS b FROM w x JOIN w y ON x.c < y.c"
SKIPPED = f"""WITH {BOUTS}, {_SPLIT}, w AS (SELECT a AS who FROM train UNION SELECT b FROM train)
SELECT seq FROM held WHERE a NOT IN (SELECT who FROM w) OR b NOT IN (SELECT who FROM w)"""
SCORES_FROM = f"""WITH {BOUTS}, s AS (SELECT seq, CASE WHEN seq % 5 <> 0 AND seq % 11 <> 0 THEN score_a END AS x, CASE WHEN seq % 7 = 0 THEN NULL ELSE score_b END AS y FROM bouts)
SELECT seq, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round(x, 6) END AS score_a, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round(y, 6) END AS score_b FROM s"""
QUARANTINE = f"""WITH {BOUTS}, o AS (SELECT seq, CASE seq % 9 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN -1.0::DOUBLE ELSE outcome END AS outcome FROM bouts)
SELECT seq, coalesce(outcome IN (0.0, 0.5, 1.0), true) AS kept FROM o"""
COMPARED = f"""WITH {BOUTS} SELECT seq, a, b, CASE WHEN score_a > score_b * 1.5::DOUBLE THEN 1.0::DOUBLE WHEN score_b > score_a * 1.5::DOUBLE THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS outcome FROM bouts"""
TEAM_BOUTS = f"""WITH {BOUTS}, g AS (SELECT c AS competitor, CAST(c AS BIGINT) % 10 AS team, (20 + CAST(c AS BIGINT) % 11)::DOUBLE AS mu, (4 + CAST(c AS BIGINT) % 5)::DOUBLE AS sigma,
    (4 + CAST(c AS BIGINT) % 5) * (4 + CAST(c AS BIGINT) % 5) + 0.083::DOUBLE * 0.083::DOUBLE AS v FROM (SELECT a AS c FROM bouts UNION SELECT b FROM bouts)),
s AS (SELECT team, sum(mu) AS m, sum(v) AS s, count(*) AS n FROM g GROUP BY team),
t AS (SELECT w.team AS winner, l.team AS loser, w.m - l.m AS d, sqrt(4.166::DOUBLE * 4.166::DOUBLE * (w.n + l.n) + w.s + l.s) AS c FROM s w JOIN s l ON w.team % 2 = 0 AND l.team = w.team + 1),
k AS (SELECT winner, loser, c, d / c AS t, {_pdf("d / c")} / {_cdf("d / c")} AS shift FROM t),
moves AS (SELECT winner AS team, 1.0::DOUBLE AS sign, c, shift, shift * (shift + t) AS shrink FROM k UNION ALL SELECT loser, -1.0::DOUBLE, c, shift, shift * (shift + t) FROM k)
SELECT g.team, competitor, round(CASE WHEN c IS NULL THEN mu ELSE mu + sign * v / c * shift END, 6) AS mu, round(CASE WHEN c IS NULL THEN sigma ELSE sqrt(v * greatest(1 - v / (c * c) * shrink, 0)) END, 6) AS sigma FROM g LEFT JOIN moves ON moves.team = g.team"""
LEAST_COMPARED = f"WITH {RATED} SELECT competitor, games FROM rated ORDER BY games, competitor LIMIT 2"
TEAM_MATCHES = f"""WITH {RATED}, t AS (SELECT CAST(competitor AS BIGINT) % 10 AS team, round(sum(rating), 4) AS mu FROM rated GROUP BY 1), k AS (SELECT team, mu, row_number() OVER (ORDER BY mu DESC, team) - 1 AS k FROM t)
SELECT x.team AS a, y.team AS b, round(x.mu - y.mu, 4) AS gap FROM k x JOIN k y ON x.k % 2 = 0 AND y.k = x.k + 1"""
VOTES = f"""WITH {BOUTS}, v AS (SELECT seq, a, [2.0, 1.5, 1.0, 1.0, 0.8][seq % 5 + 1]::DOUBLE AS weight, (('0x' || md5(seq || ':3')[1:8])::BIGINT % 1000) / 1000.0::DOUBLE AS chance FROM bouts)
SELECT seq, a, CAST(unnest(range(1, CAST(floor(weight) + CASE WHEN chance < weight - floor(weight) THEN 1 ELSE 0 END AS BIGINT) + 1)) AS INTEGER) AS copy FROM v"""
CRITERIA = f"""WITH {BOUTS}, {SIDES}, c AS (SELECT 'points' AS criterion, who AS competitor, round(avg(pf), 6) AS rating FROM sides GROUP BY who UNION ALL SELECT 'wins', who, round(avg(score), 6) FROM sides GROUP BY who UNION ALL SELECT 'other', who, 1.0 FROM sides GROUP BY who)
SELECT competitor, round(sum(rating * w) / sum(w), 4) AS rating, count(*) AS criteria FROM (SELECT *, CASE criterion WHEN 'points' THEN 0.25::DOUBLE WHEN 'wins' THEN 3.0::DOUBLE END AS w FROM c) WHERE w IS NOT NULL GROUP BY competitor"""
EXPLORE = f"""WITH {RATED}, near AS ({NEAREST.replace("WITH " + RATED, "")}), reach AS (
  SELECT x.competitor, y.competitor AS opponent, row_number() OVER (PARTITION BY x.competitor ORDER BY y.rating, y.competitor) - 1 AS k, count(*) OVER (PARTITION BY x.competitor) AS n
  FROM rated x JOIN rated y ON x.competitor <> y.competitor AND y.rating >= x.rating - 100 AND y.rating <= x.rating + 100),
drawn AS (SELECT competitor, opponent AS drawn FROM reach WHERE k = floor(('0x' || md5(competitor || ':6')[1:8])::BIGINT / 4294967296.0::DOUBLE * n) AND ('0x' || md5(competitor || ':5')[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE)
SELECT competitor, coalesce(drawn, opponent) AS opponent FROM near LEFT JOIN drawn USING (competitor)"""
WHR_OPTIMUM = f"WITH {BOUTS} SELECT who AS competitor, count(DISTINCT ts::DATE) AS days, true AS settled FROM (SELECT a AS who, ts FROM bouts UNION ALL SELECT b, ts FROM bouts) GROUP BY who"


#: Bouts of periods of five days that end a day or more before the last bout.
_CLOSED = f"""{BOUTS.replace("bouts AS", "every AS")}, bouts AS (SELECT * FROM every
  WHERE TIMESTAMP '1970-01-01' + to_days(CAST(5 * (datediff('day', DATE '1970-01-01', ts::DATE) // 5 + 1) AS INTEGER)) <= (SELECT max(ts) FROM every) - INTERVAL 1 DAY)"""


def periods(second: bool, bouts: str = BOUTS) -> str:
    """Rating periods of five days as a recursion over them, all competitors in each step."""
    slope, k2 = ("1.0::DOUBLE", "1.0::DOUBLE") if second else ("(ln(10) / 400)", f"({_Q2})")
    new = "0.0::DOUBLE AS r, 350.0::DOUBLE / 173.7178::DOUBLE AS d, 0.06::DOUBLE AS v" if second else "1500.0::DOUBLE AS r, 350.0::DOUBLE AS d, 0.0::DOUBLE AS v"
    waited = "least(350.0::DOUBLE / 173.7178::DOUBLE, sqrt(d * d + (k - last) * v * v))" if second else "least(350.0::DOUBLE, sqrt(d * d + 34.6::DOUBLE * 34.6::DOUBLE * (k + 1 - last)))"
    f = lambda x: _F.format(x=x)
    if second:
        high = f"CASE WHEN h.d2 > h.p2 + h.v THEN ln(h.d2 - h.p2 - h.v) ELSE h.a - 0.5::DOUBLE * list_min(list_filter(range(1, 201), lambda n: n = 200 OR {f('(h.a - n * 0.5::DOUBLE)')} >= 0)) END"
        mid = "(z.lo + (z.lo - z.hi) * z.fl / (z.fh - z.fl))"
        root = f"""(list_transform([{{'a': ln(w.v * w.v), 'p2': w.d * w.d, 'v': 1 / info, 'd2': gain / info * gain / info}}], lambda h: (list_transform([{high}], lambda b: exp(list_reduce([{{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE, 'fl': 0.0::DOUBLE, 'fh': 0.0::DOUBLE}} for _ in range(40)],
          lambda z, _: CASE WHEN abs(z.hi - z.lo) <= 1e-6::DOUBLE THEN z ELSE (list_transform([{{'m': {mid}, 'f': (list_transform([{mid}], lambda m: {f('m')}))[1]}}],
            lambda q1: {{'lo': CASE WHEN q1.f * z.fh < 0 THEN z.hi ELSE z.lo END, 'hi': q1.m, 'fl': CASE WHEN q1.f * z.fh < 0 THEN z.fh ELSE z.fl / 2 END, 'fh': q1.f}}))[1] END,
          {{'lo': h.a, 'hi': b, 'fl': {f('h.a')}, 'fh': {f('b')}}}).lo / 2)))[1]))[1]"""
        after = f"CASE WHEN info IS NULL THEN w.v ELSE {root} END AS nv"
        total = "(1 / (dd * dd + nv * nv) + info)"
        r, d = f"CASE WHEN info IS NULL THEN r ELSE r + gain / {total} END", f"CASE WHEN info IS NULL THEN d ELSE sqrt(1 / {total}) END"
        shown = "round(greatest(100.0::DOUBLE, r * 173.7178::DOUBLE + 1500), 6) AS rating, round(least(350.0::DOUBLE, d * 173.7178::DOUBLE), 6) AS spread"
    else:
        after = "w.v AS nv"
        total = f"(1 / (dd * dd) + {_Q2} * info)"
        r, d = f"CASE WHEN info IS NULL THEN r ELSE greatest(100.0::DOUBLE, r + 0.0057565::DOUBLE / {total} * gain) END", f"CASE WHEN info IS NULL THEN d ELSE sqrt(1 / {total}) END"
        shown = "round(r, 6) AS rating, round(d, 6) AS spread"
    return f"""WITH RECURSIVE {bouts}, {SIDES.replace("SELECT league, a AS who", "SELECT ts, league, a AS who").replace("SELECT league, b, a", "SELECT ts, league, b, a")},
days AS (SELECT datediff('day', DATE '1970-01-01', ts::DATE) // 5 AS day, who, other, score FROM sides),
s AS (
  SELECT (SELECT min(day) FROM days) - 1 AS k, c, {new}, NULL::BIGINT AS last, 0::BIGINT AS games FROM (SELECT DISTINCT who AS c FROM days)
  UNION ALL
  SELECT k + 1, c, {r}, {d}, nv, CASE WHEN info IS NULL THEN last ELSE k + 1 END, games + coalesce(n, 0) FROM (
    SELECT u.*, {after} FROM (
      SELECT x.k, x.c, x.r, x.d AS od, CASE WHEN x.last IS NULL THEN x.d ELSE {waited.replace("d * d", "x.d * x.d").replace("v * v", "x.v * x.v").replace("last", "x.last").replace("(k", "(x.k")} END AS dd, x.v, x.last, x.games, info, gain, n
      FROM s x LEFT JOIN (
        SELECT m.c, sum(g * g * e * (1 - e)) AS info, sum(g * (score - e)) AS gain, count(*) AS n FROM (
          SELECT y.c, y.score, y.g, 1 / (1 + exp(-y.g * (y.r - y.o) * {slope})) AS e FROM (
            SELECT me.c, t.score, me.r, you.r AS o, 1 / sqrt(1 + 3 * {k2} * pow(CASE WHEN you.last IS NULL THEN you.d ELSE {waited.replace("d * d", "you.d * you.d").replace("v * v", "you.v * you.v").replace("last", "you.last").replace("(k", "(you.k")} END, 2) / (pi() * pi())) AS g
            FROM s me JOIN days t ON t.who = me.c AND t.day = me.k + 1 JOIN s you ON you.c = t.other) y) m GROUP BY m.c) q ON q.c = x.c
      WHERE x.k < (SELECT max(day) FROM days)) u, LATERAL (SELECT u.v, u.dd AS d) w)
)
SELECT c AS competitor, {shown}, games, last FROM s WHERE k = (SELECT max(day) FROM days)""".replace("CASE WHEN info IS NULL THEN d ELSE", "CASE WHEN info IS NULL THEN od ELSE")


GLICKO_PERIODS, GLICKO2_PERIODS = periods(False), periods(True)
GLICKO_PERIODS_STREAM, GLICKO2_PERIODS_STREAM = periods(False, _CLOSED), periods(True, _CLOSED)

PYTHAGOREAN_HISTORY = f"""WITH {BOUTS}, two AS (SELECT seq, 'a' AS side, a AS who, score_a AS pf, score_b AS pa FROM bouts UNION ALL SELECT seq, 'b', b, score_b, score_a FROM bouts),
k AS (SELECT seq, side, 1 / (1 + pow((coalesce(sum(pa) OVER u, 0) + 1) / (coalesce(sum(pf) OVER u, 0) + 1), 2.37::DOUBLE)) AS r FROM two WINDOW u AS (PARTITION BY who ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, a, b, round(CASE WHEN x.r >= y.r THEN x.r * (1 - y.r) / (x.r * (1 - y.r) + y.r * (1 - x.r)) ELSE 1 - y.r * (1 - x.r) / (y.r * (1 - x.r) + x.r * (1 - y.r)) END, 9) AS predicted, outcome
FROM bouts JOIN k x USING (seq) JOIN k y USING (seq) WHERE x.side = 'a' AND y.side = 'b'"""

#: The inverse of Colley's matrix, row by row in one list, updated by each bout.
COLLEY_HISTORY = f"""WITH {BOUTS}, ids AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT a AS c FROM bouts UNION SELECT b FROM bouts)),
ms AS (SELECT list(seq ORDER BY seq) AS seqs, (SELECT count(*) FROM ids) AS n, list(CAST({{'i': x.i, 'j': y.i, 's': outcome, 'inv': NULL, 'b': NULL, 'p': NULL}} AS STRUCT(i BIGINT, j BIGINT, s DOUBLE, inv DOUBLE[], b DOUBLE[], p DOUBLE[])) ORDER BY seq) AS l
  FROM bouts JOIN ids x ON x.c = a JOIN ids y ON y.c = b),
f AS (SELECT seqs, list_reduce(l, lambda acc, m: (list_transform([list_transform(range(n), lambda k: acc.inv[k * n + m.i + 1] - acc.inv[k * n + m.j + 1])], lambda u:
    CAST({{'i': m.i, 'j': m.j, 's': m.s,
      'inv': (list_transform([1 / (1 + u[m.i + 1] - u[m.j + 1])], lambda d: list_transform(acc.inv, lambda v, t: v - d * u[(t - 1) // n + 1] * u[(t - 1) % n + 1])))[1],
      'b': list_transform(acc.b, lambda v, t: CASE WHEN t = m.i + 1 THEN v + m.s - 0.5 WHEN t = m.j + 1 THEN v + 0.5 - m.s ELSE v END),
      'p': list_append(acc.p, 1 / (1 + exp(-4 * list_inner_product(u, acc.b))))}} AS STRUCT(i BIGINT, j BIGINT, s DOUBLE, inv DOUBLE[], b DOUBLE[], p DOUBLE[]))))[1],
    CAST({{'i': 0, 'j': 0, 's': 0, 'inv': list_transform(range(n * n), lambda t: CASE WHEN t // n = t % n THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 'b': list_transform(range(n), lambda _: 1.0::DOUBLE), 'p': []}} AS STRUCT(i BIGINT, j BIGINT, s DOUBLE, inv DOUBLE[], b DOUBLE[], p DOUBLE[]))).p AS p FROM ms)
SELECT seq, a, b, round(p, 7) AS predicted, outcome FROM (SELECT unnest(seqs) AS seq, unnest(p) AS p FROM f) JOIN bouts USING (seq)"""


#: Games whose sequence number is a multiple of 10 have no result in the text, and of 7 another form of date.
PGN = f"""WITH {BOUTS} SELECT 'p' || a AS a, 'p' || b AS b, outcome, CASE WHEN seq % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, CAST(seq AS VARCHAR) AS game_id, CAST(CASE WHEN seq % 3 = 0 THEN 1500 ELSE 1400 + seq % 300 END AS VARCHAR) AS white_elo FROM bouts WHERE seq % 10 <> 0"""

SCHEDULE = f"""WITH {BOUTS} SELECT CASE WHEN seq % 2 = 0 THEN 'Team ' || a ELSE 't' || a END AS a, 't' || b AS b, outcome_ AS outcome, strftime(ts, '%Y-%m-%d 00:00:00') AS ts, x AS score_a, y AS score_b, CASE WHEN seq % 2 = 0 THEN 'Hall ' || seq % 5 END AS venue
FROM (SELECT *, floor(score_a) AS x, floor(score_b) AS y, CASE WHEN floor(score_a) > floor(score_b) THEN 1.0::DOUBLE WHEN floor(score_a) < floor(score_b) THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS outcome_ FROM bouts) WHERE seq % 9 <> 0"""

KEPT = f"WITH {BOUTS} SELECT seq, a, b, outcome, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM bouts"

STATE_QUARANTINE = f"""SELECT competitor, CASE WHEN CAST(competitor AS BIGINT) % 6 IN (0, 5) THEN rating END AS rating,
CASE CAST(competitor AS BIGINT) % 6 WHEN 1 THEN 'another type' WHEN 2 THEN 'another version' WHEN 3 THEN 'state' WHEN 4 THEN 'not a document' END AS reason FROM ({ELO})"""

OLDER_STATES = f"""WITH {SUPPLIER}, base AS (SELECT s_suppkey AS k, 1500 + floor(s_acctbal / 100) AS x FROM supplier),
known AS (SELECT CAST(k AS VARCHAR) AS c, CASE WHEN k % 3 > 0 THEN x WHEN k % 4 > 0 THEN x + 50 ELSE 1500 END::DOUBLE AS rating, CASE WHEN k % 5 > 0 THEN 60 + k % 7 ELSE 350 END::DOUBLE AS rd FROM base)
SELECT order_key, a, b, x.rating AS rating_a, x.rd AS rd_a, y.rating AS rating_b, y.rd AS rd_b FROM bouts JOIN known x ON x.c = a JOIN known y ON y.c = b"""

UNSEEN = f"""WITH {BOUTS}, {_SPLIT}, {fold_ctes("r", "train", *FOLDS["elo"][:3])}, g AS (SELECT seq, a, CASE WHEN seq % 10 = 0 THEN 'new ' || b ELSE b END AS b FROM held)
SELECT seq, a, b, round(1 / (1 + pow(10.0::DOUBLE, (coalesce(y.v, 400.0::DOUBLE) - coalesce(x.v, 400.0::DOUBLE)) / 400)), 9) AS predicted FROM g LEFT JOIN r x ON x.competitor = a LEFT JOIN r y ON y.competitor = b"""

#: Bouts come in four blocks, those whose number is a multiple of 97 one block later: late if a bout after them was in time.
STREAM = f"""WITH {BOUTS.replace("bouts AS", "every AS")}, n AS (SELECT *, least(3, seq * 4 // (SELECT max(seq) + 1 FROM every)) AS block, seq % 97 = 0 AS moved FROM every),
tops AS (SELECT block, max(ts) AS top FROM n WHERE NOT moved OR block = 3 GROUP BY block),
late AS (SELECT n.seq FROM n JOIN tops USING (block) WHERE moved AND block < 3 AND ts < top),
bouts AS (SELECT * FROM n WHERE seq NOT IN (SELECT seq FROM late)), {fold_ctes("r", "bouts", *FOLDS["elo"][:3])}
SELECT 'rating' AS kind, competitor AS name, round(v, 6) AS rating FROM r UNION ALL SELECT 'late', CAST(seq AS VARCHAR), NULL FROM late"""

STREAM_POINTS = f"""WITH {BOUTS}, {SIDES.replace("SELECT league, a AS who", "SELECT ts, league, a AS who").replace("SELECT league, b, a", "SELECT ts, league, b, a")}
SELECT who AS competitor, strftime(ts::DATE, '%Y-%m-%d 00:00:00') AS window_start, round(sum(pf), 4) AS pts_for, round(sum(pa), 4) AS pts_against FROM sides
GROUP BY who, ts::DATE HAVING ts::DATE::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) FROM bouts) - INTERVAL 1 DAY"""


def _team_bouts() -> str:
    """Teams are the suppliers of an order at odd and at even places; states by list_reduce, league by league."""
    side = lambda team, f: f"list_sum(list_transform({team}, lambda i: {f}))"
    grown = "acc.x[i].s * acc.x[i].s + 0.083::DOUBLE * 0.083::DOUBLE"
    margin = "sqrt(len(b.a) + len(b.b)) * 4.166::DOUBLE * 0.12566134685507402::DOUBLE"
    first = f"{{'d': {side('b.a', 'acc.x[i].m')} - {side('b.b', 'acc.x[i].m')}, 'c': sqrt((len(b.a) + len(b.b)) * 4.166::DOUBLE * 4.166::DOUBLE + {side('b.a', grown)} + {side('b.b', grown)}), 'u': CASE WHEN b.s = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END}}"
    t = f"{{'c': k.c, 'u': k.u, 't': CASE WHEN b.s = 0.5 THEN k.d / k.c ELSE (k.u * k.d - {margin}) / k.c END, 'e': {margin} / k.c}}"
    below = f"{{'z': z, 'w': CASE WHEN b.s = 0.5 THEN {_cdf('z.t + z.e')} - {_cdf('z.t - z.e')} ELSE {_cdf('z.t')} END, 'lo': {_pdf('z.t - z.e')}, 'hi': {_pdf('z.t + z.e')}, 'p': {_pdf('z.t')}}}"
    shift = "{'z': w.z, 'w': w.w, 'lo': w.lo, 'hi': w.hi, 'v': CASE WHEN w.w <= 0 THEN 0.0::DOUBLE WHEN b.s = 0.5 THEN (w.lo - w.hi) / w.w ELSE w.p / w.w END}"
    shrink = "{'c': v.z.c, 'g': CASE WHEN b.s = 0.5 THEN -v.v ELSE v.z.u * v.v END, 'h': CASE WHEN b.s <> 0.5 THEN v.v * (v.v + v.z.t) WHEN v.w <= 0 THEN 0.0::DOUBLE ELSE v.v * v.v + ((v.z.e - v.z.t) * v.lo + (v.z.e + v.z.t) * v.hi) / v.w END}"
    out = f"(list_transform([{first}], lambda k: {t}))[1]"
    for name, expr in (("z", below), ("w", shift), ("v", shrink)):
        out = f"(list_transform([{out}], lambda {name}: {expr}))[1]"
    v = "(y.s * y.s + 0.083::DOUBLE * 0.083::DOUBLE)"
    moved = f"list_transform(acc.x, lambda y, i: CASE WHEN list_contains(b.a, i) OR list_contains(b.b, i) THEN {{'m': y.m + CASE WHEN list_contains(b.a, i) THEN 1 ELSE -1 END * {v} / r.c * r.g, 's': sqrt({v} * (1 - {v} / (r.c * r.c) * r.h)), 'n': y.n + 1}} ELSE y END)"
    kind = "STRUCT(a BIGINT[], b BIGINT[], s DOUBLE, x STRUCT(m DOUBLE, s DOUBLE, n BIGINT)[])"
    return f"""WITH rev AS (SELECT l_orderkey, l_suppkey, round(sum(l_extendedprice), 2) AS rv FROM lineitem GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) % 2 AS odd FROM rev),
tb AS (SELECT l_orderkey, list(l_suppkey) FILTER (WHERE odd = 1) AS a, list(l_suppkey) FILTER (WHERE odd = 0) AS b, avg(rv) FILTER (WHERE odd = 1) AS ra, avg(rv) FILTER (WHERE odd = 0) AS rb FROM pos GROUP BY 1 HAVING count(*) > 1),
ids AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) AS i FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
ms AS (SELECT o_orderpriority AS league, (SELECT count(*) FROM ids) AS n, list(CAST({{'a': list_transform(a, lambda k: mp[k]), 'b': list_transform(b, lambda k: mp[k]),
   's': CASE WHEN abs(ra - rb) <= 0.1 * (ra + rb) THEN 0.5 WHEN ra > rb THEN 1.0 ELSE 0.0 END, 'x': NULL}} AS {kind}) ORDER BY o_orderdate, l_orderkey) AS l FROM tb JOIN orders ON o_orderkey = l_orderkey CROSS JOIN (SELECT map_from_entries(list((l_suppkey, i))) AS mp FROM ids) GROUP BY 1),
f AS (SELECT league, list_reduce(l, lambda acc, b: CAST({{'a': b.a, 'b': b.b, 's': b.s, 'x': (list_transform([{out}], lambda r: {moved}))[1]}} AS {kind}),
   CAST({{'a': [], 'b': [], 's': 0, 'x': list_transform(range(n), lambda _: {{'m': 25.0::DOUBLE, 's': 8.333::DOUBLE, 'n': 0}})}} AS {kind})).x AS x FROM ms)
SELECT league, CAST(l_suppkey AS VARCHAR) AS competitor, round(x[i].m, 6) AS mu, round(x[i].s, 6) AS sigma, x[i].n AS games FROM f, ids WHERE x[i].n > 0"""


TEAM_SEQUENCE = _team_bouts()
