"""DuckDB SQL for the queries of the catalogue, written apart from the operators."""

from __future__ import annotations

from sessionloom.functions.expr import UNIT
from sessionloom.operators import voting
from sessionloom.operators.covisitation import CovisSpec

U = """u AS (SELECT user_id AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS aid, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
 CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS type, event_id AS eid FROM events WHERE event_type <> 'error')"""
V = (
    U
    + """,
v AS (SELECT CASE WHEN n < 1000 THEN session * 1000 + n ELSE -(session * 2147483648 + n) END AS session, aid, ts, type, eid FROM
 (SELECT *, CAST(sum(cut) OVER (PARTITION BY session ORDER BY ts, eid) AS BIGINT) AS n FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, eid) > 86400 THEN 1 ELSE 0 END AS cut FROM u)))"""
)
#: A session's events against a split seven days before the last event.
S = (
    V
    + """,
s AS (SELECT *, min(ts) OVER (PARTITION BY session) AS first_ts, max(ts) OVER (PARTITION BY session) AS last_ts, (SELECT max(ts) - 604800 FROM v) AS split_ts FROM v)"""
)


def truth(source: str) -> str:
    """Labels of every event but the last from those after it, by a self-join."""
    return f"""(SELECT a.session, a.aid, a.ts, a.type, a.eid,
 nullif(arg_min(b.aid, b.rn) FILTER (WHERE b.type = 0), 0) AS label_click,
 coalesce(list_sort(list(DISTINCT b.aid) FILTER (WHERE b.type = 1)), []) AS label_carts,
 coalesce(list_sort(list(DISTINCT b.aid) FILTER (WHERE b.type = 2)), []) AS label_orders, a.rn AS pos, any_value(a.n) AS n
 FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS rn, count(*) OVER (PARTITION BY session) AS n FROM {source}) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS rn FROM {source}) b ON a.session = b.session AND b.rn > a.rn
 GROUP BY ALL)"""


CUT = "(1 + ((session % 1000003) * 7919 + 42) % 1000003 % (n - 1))"


def covis(spec: CovisSpec, source: str, t_min: int, t_max: int, chunk: int = 50_000, top_n: int | None = None) -> str:
    """The spec as a SELECT (aid_x, aid_y, wgt_e9, rank) over source, in parentheses."""
    side = lambda text, a: text.replace("type", f"{a}.type")
    e = f"SELECT * FROM {source}"
    if spec.since_days is not None:
        e += f" WHERE ts > {t_max - spec.since_days * 86_400}"
    if spec.left == spec.right:
        e = f"SELECT * FROM ({e}) WHERE {spec.left}"
    if spec.started_days is not None:
        e = f"SELECT * FROM ({e}) QUALIFY min(ts) OVER (PARTITION BY session) > {t_max - spec.started_days * 86_400}"
    if spec.tail:
        e = f"SELECT * FROM ({e}) QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) <= {spec.tail}"
    e = f"SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS k, row_number() OVER (PARTITION BY session, aid ORDER BY ts, eid) AS nth FROM ({e})"
    where = [side(spec.left, "x"), side(spec.right, "y"), spec.pair]
    if spec.reach:
        where.append(f"{'y.k - x.k' if spec.ahead else 'abs(y.k - x.k)'} BETWEEN 1 AND {spec.reach}")
    if spec.within:
        where.append(f"y.ts - x.ts BETWEEN {1 if spec.ahead else 1 - spec.within} AND {spec.within - 1}")
    if spec.x_first:
        where.append("x.k = 1")
    if spec.y_first:
        where.append("y.nth = 1")
    keys = ", ".join(k.replace(" div {chunk}", f" // {chunk}") for k in spec.key)
    way = " DESC" if spec.latest else ""
    order = f"x.ts{way}, x.eid{way}, y.ts{way}, y.eid{way}"
    if spec.closest:
        order = "abs(y.ts - x.ts), x.ts, x.eid, y.ts, y.eid"
    weight = spec.weight.format(t_min=t_min, t_max=t_max)
    n = spec.top_n if top_n is None else top_n
    return f"""(SELECT aid_x, aid_y, wgt_e9, row_number() OVER (PARTITION BY aid_x ORDER BY wgt_e9 DESC, aid_y) AS rank FROM
 (SELECT aid_x, aid_y, CAST(sum(w) AS BIGINT) AS wgt_e9 FROM
 (SELECT x.aid AS aid_x, y.aid AS aid_y, CAST(round(({weight}) * {UNIT}::DOUBLE) AS BIGINT) AS w FROM ({e}) x JOIN ({e}) y ON x.session = y.session
  WHERE {" AND ".join(f"({w})" for w in where)} QUALIFY row_number() OVER (PARTITION BY {keys}, x.aid, y.aid ORDER BY {order}) = 1)
 GROUP BY aid_x, aid_y) {f"QUALIFY rank <= {n}" if n else ""})"""


def seeds(source: str) -> str:
    """(session, list, aid, pos) of the seven seed lists."""
    flagged = f"""SELECT *, max(d) OVER (PARTITION BY session) AS max_d, max(ts) OVER (PARTITION BY session) AS max_ts,
 row_number() OVER (PARTITION BY session, d ORDER BY ts, eid) AS fwd, row_number() OVER (PARTITION BY session, d ORDER BY ts DESC, eid DESC) AS bwd
 FROM (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY ts, eid) AS d FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, eid) > 7200 THEN 1 ELSE 0 END AS cut FROM {source}))"""
    lists = {"all": "true", "last_sub": "d = max_d", "first_of_sub": "fwd = 1", "last_of_sub": "bwd = 1", "half_hour": "ts >= max_ts - 1800", "day": "ts >= max_ts - 86400", "buys": "type IN (1, 2)"}
    rows = " UNION ALL ".join(f"SELECT session, '{k}' AS list, aid, ts, eid FROM flagged WHERE {c}" for k, c in lists.items())
    return f"""(WITH flagged AS ({flagged}), rows AS ({rows})
 SELECT session, list, aid, row_number() OVER (PARTITION BY session, list ORDER BY ts DESC, eid DESC) - 1 AS pos FROM
 (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY session, list, aid ORDER BY ts DESC, eid DESC) = 1))"""


def _fx(w: str) -> str:
    return f"CAST(round(({w}) * {UNIT}::DOUBLE) AS BIGINT)"


def _dbl(w: str, c: int) -> str:
    """The first vote of every c counts twice."""
    return f"{_fx(w)} * CASE WHEN i % {c} = 0 THEN 2 ELSE 1 END"


def _rep(w: str, c: int) -> str:
    """W is 2, 2, 1, 1, ... over every c votes; votes beyond the last c that are full don't count."""
    return f"CASE WHEN i < {c} * (size // {c}) THEN {_fx(w.replace('W', f'(CASE WHEN i % {c} < 2 THEN 2::DOUBLE ELSE 1::DOUBLE END)'))} END"


def _seeded(low: str, c: int) -> str:
    """From 1 for the first seed's votes down to `low`, by blocks of c."""
    return f"({low}::DOUBLE + (1 - {low}::DOUBLE) * (n - i // {c})::DOUBLE / n::DOUBLE)"


ONE = "1::DOUBLE"
#: The three suggesters once more, written from their description and apart from the operator:
#: (matrix, seed list, items of each list, value of a vote, seeds of the list (0: all), only sessions with one item).
SUGGESTERS = {
    "fast": {
        "long": [("220", "all", 20, _fx("0.6::DOUBLE"), 2, 0), ("217", "last_of_sub", 15, _fx("0.3::DOUBLE"), 0, 0), ("115", "all", 20, _fx("0.6::DOUBLE"), 2, 0)],
        "short": [
            ("701", "all", 30, _rep("W", 30), 0, 1),
            ("93", "all", 20, _dbl(_seeded("0.1", 20), 20), 0, 0),
            ("217", "all", 20, _dbl(ONE, 20), 2, 0),
            ("115", "all", 20, _dbl(ONE, 20), 2, 0),
            ("235", "last_sub", 10, _dbl("1::DOUBLE - 0.1::DOUBLE * (i // 10)", 10), 0, 0),
            ("232", "last_of_sub", 20, _dbl(ONE, 20), 0, 0),
        ],
        "second": ("220", "best", 10, _dbl(ONE, 10), 0, 0),
    },
    "clicks": {
        "long": [("220", "all", 40, _fx("0.6::DOUBLE"), 2, 0), ("217", "last_of_sub", 30, _fx("0.3::DOUBLE"), 0, 0), ("115", "all", 40, _fx("0.6::DOUBLE"), 2, 0)],
        "short": [
            ("157", "day", 40, _fx(ONE), 0, 0),
            ("93", "fast", 20, _fx("0.5::DOUBLE"), 0, 0),
            ("701", "all", 30, _rep("W", 30), 0, 1),
            ("93", "all", 1_000_000, _fx("greatest(1::DOUBLE - 0.35::DOUBLE * pos, 0.001::DOUBLE) * greatest(1::DOUBLE - 0.005::DOUBLE * (rank - 1), 0.01::DOUBLE)"), 0, 0),
            ("217", "all", 40, _dbl(ONE, 40), 2, 0),
            ("115", "all", 40, _dbl(ONE, 40), 2, 0),
            ("235", "last_sub", 20, _dbl("1::DOUBLE - 0.1::DOUBLE * (i // 20)", 20), 0, 0),
            ("232", "last_of_sub", 40, _dbl(ONE, 40), 0, 0),
        ],
        "second": ("220", "best", 20, _dbl(ONE, 20), 0, 0),
    },
    "orders": {
        "long": [
            ("90", "buys", 40, _dbl("0.05::DOUBLE", 40), 0, 0),
            ("99", "buys", 40, _dbl("0.1::DOUBLE", 40), 0, 0),
            ("116", "all", 40, _dbl("0.05::DOUBLE", 40), 0, 0),
            ("220", "all", 20, _dbl("0.05::DOUBLE", 20), 1, 0),
            ("226", "buys", 20, _dbl("0.05::DOUBLE", 20), 1, 0),
            ("217", "last_of_sub", 5, _dbl("0.25::DOUBLE", 5), 0, 0),
            ("217", "first_of_sub", 5, _dbl("0.125::DOUBLE", 5), 0, 0),
            ("155", "day", 40, _dbl("0.05::DOUBLE", 40), 0, 0),
            ("116", "fast", 20, _dbl("0.05::DOUBLE", 20), 0, 0),
            ("239", "fast", 20, _dbl("0.05::DOUBLE", 20), 0, 0),
        ],
        "short": [
            ("95", "all", 30, _rep(f"W * {_seeded('0.25', 30)}", 30), 0, 0),
            ("90", "buys", 30, _rep("W / 2", 30), 0, 0),
            ("116", "all", 30, _rep(f"W * {_seeded('0.25', 30)}", 30), 0, 0),
            ("99", "buys", 30, _rep("W / 2", 30), 0, 0),
            ("155", "day", 40, _rep(ONE, 40), 0, 0),
            ("116", "fast", 20, _rep(f"W * {_seeded('0.25', 20)}", 20), 0, 0),
            ("239", "fast", 20, _rep(f"W * {_seeded('0.25', 20)}", 20), 0, 0),
            ("220", "all", 55, _rep("W", 55), 1, 0),
            ("701", "all", 20, _rep("W", 20), 0, 1),
            ("700", "all", 20, _rep("W", 20), 0, 1),
            ("226", "buys", 20, _rep("W", 20), 1, 0),
            ("239", "half_hour", 20, _rep("2 * W / n", 20), 0, 0),
            ("235", "last_sub", 5, _dbl("0.5::DOUBLE - 0.05::DOUBLE * (i // 5)", 5), 0, 0),
            ("232", "last_of_sub", 55, _rep("W - 0.1::DOUBLE * (i // 55)", 55), 0, 0),
            ("232", "first_of_sub", 10, _rep("W / 2 - 0.05::DOUBLE * (i // 10)", 10), 0, 0),
        ],
        "second": None,
    },
}


def vote(spec: voting.VoteSpec, events: str, tag: str, fast: str | None = None, popular_type: int | None = None) -> str:
    """CTEs that end in {tag}(session, aid, pos); needs seeds0 and one table m_{matrix} for each matrix."""
    all_seeds = "SELECT * FROM seeds0"
    if fast:
        all_seeds += f" UNION ALL SELECT session, 'fast', aid, pos FROM {fast} WHERE pos < 10"
    out = [f"{tag}_n AS (SELECT session, count(*) AS n_all FROM seeds0 WHERE list = 'all' GROUP BY session)", f"{tag}_s AS (SELECT s.*, n_all, count(*) OVER (PARTITION BY s.session, list) AS n FROM ({all_seeds}) s JOIN {tag}_n USING (session))"]

    hand = SUGGESTERS[spec.name]

    def one(src: int, long: bool, v: tuple, table: str) -> str:
        matrix, seeds, cap, value, limit, lone = v
        side = f"n_all >= {spec.long_from}" if long else f"n_all < {spec.long_from}"
        side += (" AND n_all = 1" if lone else "") + (f" AND s.pos < {limit}" if limit else "")
        got = f"""SELECT s.session, m.aid_y, m.rank, s.pos, s.n, row_number() OVER (PARTITION BY s.session ORDER BY s.pos, m.rank) - 1 AS i, count(*) OVER (PARTITION BY s.session) AS size
 FROM {table} s JOIN m_{matrix} m ON m.aid_x = s.aid AND m.rank <= {cap} WHERE s.list = '{seeds}' AND {side}"""
        return f"SELECT session, aid_y AS aid, v, {src} AS src, i FROM (SELECT *, {value} AS v FROM ({got})) WHERE v IS NOT NULL"

    rows = [one(10 + k, True, v, f"{tag}_s") for k, v in enumerate(hand["long"])] + [one(110 + k, False, v, f"{tag}_s") for k, v in enumerate(hand["short"])]
    kind = "WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 3"
    rows.append(f"""SELECT session, aid, CAST(round((pow(2::DOUBLE, {spec.start}::DOUBLE + {1 - spec.start}::DOUBLE * CASE WHEN cnt > 1 THEN i::DOUBLE / (cnt - 1) ELSE 0::DOUBLE END) - 1) * (CASE type {kind} END)::DOUBLE * {UNIT}::DOUBLE) AS BIGINT) AS v, 0 AS src, i
 FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, eid) - 1 AS i, count(*) OVER (PARTITION BY session) AS cnt FROM {events}) JOIN {tag}_n USING (session) WHERE n_all >= {spec.long_from}""")
    for long, given in ((True, spec.long_seed_votes), (False, spec.short_seed_votes)):
        for k, (name, w) in enumerate(given):
            src = (60 if long else 116) if name == "fast" else 1 + k
            rows.append(f"SELECT session, aid, {round(w * UNIT)} AS v, {src} AS src, pos + 1000 AS i FROM {tag}_s WHERE list = '{name}' AND n_all {'>=' if long else '<'} {spec.long_from}")
    out.append(f"{tag}_v1 AS ({' UNION ALL '.join(rows)})")
    votes = f"{tag}_v1"
    ranked = lambda t: f"SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY v DESC, src, i) AS place FROM (SELECT session, aid, sum(v) AS v, min(src::BIGINT * 1000000000 + i) // 1000000000 AS src, min(src::BIGINT * 1000000000 + i) % 1000000000 AS i FROM {t} GROUP BY session, aid)"
    if hand["second"]:
        out.append(f"{tag}_b AS (SELECT session, 'best' AS list, aid, 0 AS pos, n_all, 1 AS n FROM ({ranked(votes)}) r JOIN {tag}_n USING (session) WHERE place = 1 AND n_all < {spec.long_from} AND NOT EXISTS (SELECT 1 FROM {tag}_s o WHERE o.list = 'all' AND o.session = r.session AND o.aid = r.aid))")
        out.append(f"{tag}_v2 AS (SELECT * FROM {votes} UNION ALL {one(200, False, hand['second'], f'{tag}_b')})")
        votes = f"{tag}_v2"
    seen = f"SELECT session, aid, pos FROM {tag}_s WHERE list = 'all'"
    long = f"n_all >= {spec.long_from}"
    keep = f"o.pos IS NULL{f' OR {long}' if spec.long_seen == 'votes' else ''}"
    lists = f"SELECT r.session, r.aid, 1 AS part, r.place AS ord FROM ({ranked(votes)}) r JOIN {tag}_n USING (session) LEFT JOIN ({seen}) o ON o.session = r.session AND o.aid = r.aid WHERE r.place <= {spec.top} AND ({keep})"
    if spec.seen == "keep":
        lists += f" UNION ALL SELECT session, aid, 0, pos FROM {tag}_s WHERE list = 'all' AND NOT ({long})"
    placed = f"SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY part, ord) - 1 AS pos FROM ({lists}) QUALIFY pos < {spec.top}"
    if popular_type is None:
        out.append(f"{tag} AS ({placed})")
        return ",\n".join(out)
    out.append(f"{tag}_p AS ({placed})")
    want = spec.top if spec.pad else 1
    out.append(f"{tag}_pop AS (SELECT aid, row_number() OVER (ORDER BY count(*) DESC, aid) - 1 AS pos FROM {events} WHERE type = {popular_type} GROUP BY aid)")
    out.append(f"{tag}_h AS (SELECT n.session, coalesce(h, 0) AS h FROM {tag}_n n LEFT JOIN (SELECT session, count(*) AS h FROM {tag}_p GROUP BY session) x ON n.session = x.session)")
    out.append(f"{tag} AS (SELECT * FROM {tag}_p UNION ALL SELECT h.session, p.aid, h.h + p.pos FROM {tag}_h h JOIN {tag}_pop p ON p.pos < least({want} - h.h, {spec.top}))")
    return ",\n".join(out)
