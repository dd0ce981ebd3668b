"""DuckDB twins of the catalogued queries, written independently of the DataFrame code; nothing is imported from it."""

from __future__ import annotations

# Weights of the Gaussian kernels by width, and (dy, first dx, last dx) of the elliptical neighbourhoods by width.
WEIGHTS = {
    3: [0.25, 0.5, 0.25],
    5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
    11: [0.008812229292562283, 0.027143577143479366, 0.06511405659938266, 0.12164907301380959, 0.17699835683135567, 0.2005654142388208,
         0.17699835683135567, 0.12164907301380959, 0.06511405659938266, 0.027143577143479366, 0.008812229292562283],
}
ELLIPSES = {
    3: [(-1, 0, 0), (0, -1, 1), (1, 0, 0)],
    5: [(-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0)],
}

# Rasters -----------------------------------------------------------------------------------------------------------
# px(image_id, y, x, v, h, w): dense pixels.

LINE = """
cell AS (SELECT l_suppkey AS image_id, CAST(l_quantity AS INT) - 1 AS y, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS x,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s FROM lineitem GROUP BY ALL),
px AS MATERIALIZED (SELECT i.image_id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, CAST(least(255, coalesce(c.s, 0) // 50000) AS INT) AS v, 50 AS h, 84 AS w
       FROM (SELECT DISTINCT l_suppkey AS image_id FROM lineitem) i CROSS JOIN range(50) a(y) CROSS JOIN range(84) b(x)
       LEFT JOIN cell c ON c.image_id = i.image_id AND c.y = a.y AND c.x = b.x)"""

EVENT = """
cell AS (SELECT user_id AS image_id, hour(ts) AS y, day(ts) - 1 AS x, sum(CAST(round(value * 100) AS BIGINT)) AS s FROM events GROUP BY ALL),
px AS MATERIALIZED (SELECT i.image_id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, CAST(least(255, coalesce(c.s, 0) // 100) AS INT) AS v, 24 AS h, 31 AS w
       FROM (SELECT DISTINCT user_id AS image_id FROM events) i CROSS JOIN range(24) a(y) CROSS JOIN range(31) b(x)
       LEFT JOIN cell c ON c.image_id = i.image_id AND c.y = a.y AND c.x = b.x)"""

BYTES = """
bytes AS (SELECT vec_id AS image_id, p - 1 AS p, CAST(greatest(0, least(255, floor((CAST(embedding[p] AS DOUBLE) + 0.5) * 255))) AS INT) AS v
          FROM embeddings, unnest(range(1, 65)) t(p))"""

TILES = BYTES + """,
px AS MATERIALIZED (SELECT image_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, v, 8 AS h, 8 AS w FROM bytes)"""

TEXT = """
chars AS (SELECT doc_id AS image_id, length(text) AS n, string_split(text, '') AS c FROM documents WHERE length(text) > 0),
known AS (SELECT image_id, n, unnest(c) AS c, unnest(range(len(c))) AS p FROM chars),
px AS MATERIALIZED (SELECT image_id, CAST(p // 64 AS INT) AS y, CAST(p % 64 AS INT) AS x, unicode(c) % 256 AS v, CAST(ceil(n / 64) AS INT) AS h, 64 AS w FROM known
       UNION ALL SELECT image_id, CAST(q // 64 AS INT), CAST(q % 64 AS INT), 0, CAST(ceil(n / 64) AS INT), 64
       FROM chars, unnest(range(n, CAST(ceil(n / 64) AS INT) * 64)) t(q))"""

# Thresholds --------------------------------------------------------------------------------------------------------

HIST = """
hist AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL)"""

OTSU = HIST + """,
cum AS (SELECT image_id, v, sum(n) OVER u AS n1, sum(n * v) OVER u AS s1, sum(n) OVER i AS tn, sum(n * v) OVER i AS ts FROM hist
        WINDOW u AS (PARTITION BY image_id ORDER BY v), i AS (PARTITION BY image_id)),
gap AS (SELECT image_id, v, CAST(n1 AS DOUBLE) AS n1, CAST(tn - n1 AS DOUBLE) AS n2,
               CASE WHEN tn > n1 THEN CAST(s1 AS DOUBLE) / CAST(n1 AS DOUBLE) - CAST(ts - s1 AS DOUBLE) / CAST(tn - n1 AS DOUBLE) END AS g FROM cum),
ranked AS (SELECT image_id, v, g, row_number() OVER (PARTITION BY image_id ORDER BY n1 * n2 * g * g DESC NULLS LAST, v) AS r FROM gap),
otsu AS (SELECT image_id, CAST(CASE WHEN g IS NULL THEN 0 ELSE v END AS DOUBLE) AS thresh FROM ranked WHERE r = 1)"""

POLARITY = """
side AS (SELECT image_id, any_value(thresh) AS thresh, avg(v) FILTER (v > thresh) AS a, avg(v) FILTER (v <= thresh) AS b
         FROM px JOIN {thresholds} USING (image_id) GROUP BY image_id)"""


def mask(condition: str, source: str = "px") -> str:
    return f"m AS MATERIALIZED (SELECT image_id, y, x, h, w, {condition} AS fg FROM {source})"


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"


OTSU_LINE = [LINE, OTSU]
LINE_MASK = [LINE, OTSU, mask("v > thresh", "px JOIN otsu USING (image_id)")]
LINE_DARK = [LINE, OTSU, mask("v <= thresh", "px JOIN otsu USING (image_id)")]


def runs_cte(name: str, source: str, side: str = "fg", extra: str = "") -> str:
    keys = "image_id" + (f", {extra}" if extra else "")
    return f"""{name} AS (SELECT {keys}, y, CAST(min(x) AS INT) AS x0, CAST(max(x) + 1 AS INT) AS x1, any_value(h) AS h, any_value(w) AS w
    FROM (SELECT *, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS g FROM {source} WHERE {side}) GROUP BY {keys}, y, g)"""


RUNS = "SELECT image_id, y, x0, x1 FROM {}"


def components(prefix: str, runs: str, connectivity: int) -> str:
    """CTEs <prefix>_comp(image_id, y, x0, x1, h, w, id, c): c is the smallest run id of the component."""
    reach = "=" if connectivity == 8 else ""
    return f"""{prefix}_node AS (SELECT *, CAST(image_id AS BIGINT) * 1000000 + y * w + x0 AS id FROM {runs}),
{prefix}_edge AS (SELECT a.id AS s, b.id AS t FROM {prefix}_node a JOIN {prefix}_node b
    ON a.image_id = b.image_id AND b.y = a.y + 1 AND b.x0 <{reach} a.x1 AND b.x1 >{reach} a.x0),
{prefix}_sym AS (SELECT s, t FROM {prefix}_edge UNION ALL SELECT t, s FROM {prefix}_edge),
{prefix}_cc(id, c) USING KEY (id) AS (SELECT id, id FROM {prefix}_node UNION
    SELECT e.t, min(k.c) FROM {prefix}_cc k JOIN {prefix}_sym e ON e.s = k.id JOIN recurring.{prefix}_cc r ON r.id = e.t
    WHERE k.c < r.c GROUP BY e.t),
{prefix}_comp AS (SELECT n.*, k.c FROM {prefix}_node n JOIN {prefix}_cc k USING (id)),
{prefix}_fact AS (SELECT image_id, c, sum(x1 - x0) AS area, bool_or(y = 0 OR y = h - 1 OR x0 = 0 OR x1 = w) AS border
    FROM {prefix}_comp GROUP BY image_id, c)"""


def labels(prefix: str) -> str:
    return f"""{prefix}_label AS (SELECT image_id, y, x0, x1, h, w,
    CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY c) AS INT) AS label FROM {prefix}_comp)"""


LINE_LABELS = [*LINE_MASK, runs_cte("r", "m"), components("f", "r", 8), labels("f")]


def reached(prefix: str, runs: str, connectivity: int, start: str) -> str:
    """CTEs <prefix>_node and <prefix>_out(id): runs connected to the runs that meet ``start``."""
    reach = "=" if connectivity == 8 else ""
    return f"""{prefix}_node AS (SELECT *, CAST(image_id AS BIGINT) * 1000000 + y * w + x0 AS id FROM {runs}),
{prefix}_edge AS (SELECT a.id AS s, b.id AS t FROM {prefix}_node a JOIN {prefix}_node b
    ON a.image_id = b.image_id AND b.y = a.y + 1 AND b.x0 <{reach} a.x1 AND b.x1 >{reach} a.x0),
{prefix}_sym AS (SELECT s, t FROM {prefix}_edge UNION ALL SELECT t, s FROM {prefix}_edge),
{prefix}_out(id) AS (SELECT id FROM {prefix}_node WHERE {start} UNION SELECT e.t FROM {prefix}_out o JOIN {prefix}_sym e ON e.s = o.id)"""


BORDER = "y = 0 OR y = h - 1 OR x0 = 0 OR x1 = w"


def swapped(base: list[str], flips: str, out: str, source: str = "m") -> list[str]:
    """The mask after the runs selected by ``flips`` (image_id, y, x0, x1) change sides."""
    return [*base, f"{out}_flip AS (SELECT image_id, y, CAST(unnest(range(x0, x1)) AS INT) AS x FROM ({flips}))",
            f"""{out} AS (SELECT m.image_id, m.y, m.x, m.h, m.w, (m.fg <> (p.x IS NOT NULL)) AS fg
    FROM {source} m LEFT JOIN {out}_flip p ON p.image_id = m.image_id AND p.y = m.y AND p.x = m.x)"""]


def dropped(base: list[str], connectivity: int, condition: str, out: str = "m2") -> list[str]:
    """The mask without the components that meet ``condition``."""
    return swapped([*base, runs_cte(f"{out}_r", "m"), components(f"{out}_k", f"{out}_r", connectivity)],
                   f"SELECT image_id, y, x0, x1 FROM {out}_k_comp JOIN {out}_k_fact USING (image_id, c) WHERE {condition}", out)


def filled(base: list[str], largest: int | None = None, out: str = "m2") -> list[str]:
    """The mask with enclosed background (of fewer than ``largest`` pixels) added: what the frame cannot reach."""
    parts = [*base, runs_cte(f"{out}_r", "m", "NOT fg"), reached(out, f"{out}_r", 4, BORDER),
             f"{out}_in AS (SELECT * EXCLUDE (id) FROM {out}_node WHERE id NOT IN (SELECT id FROM {out}_out))"]
    if largest is None:
        return swapped(parts, f"SELECT image_id, y, x0, x1 FROM {out}_in", out)
    return swapped([*parts, components(f"{out}_k", f"{out}_in", 4)],
                   f"SELECT image_id, y, x0, x1 FROM {out}_k_comp JOIN {out}_k_fact USING (image_id, c) WHERE area < {largest}", out)


def mask_result(parts: list[str], name: str = "m2", recursive: bool = True) -> str:
    return with_(*parts, runs_cte("result", name), recursive=recursive) + RUNS.format("result")


PX = "SELECT image_id, y, x, v FROM "

ORACLES: dict[str, str] = {}

# Sources, sinks, geometry ------------------------------------------------------------------------------------------

PADDED = """
padded AS (SELECT vec_id AS image_id, t.p, CASE WHEN t.p < len(embedding) THEN CAST(greatest(0, least(255, floor((CAST(embedding[t.p + 1] AS DOUBLE) + 0.5) * 255))) AS INT) ELSE 0 END AS v
           FROM embeddings, LATERAL (SELECT unnest(range(15 * CAST(ceil(len(embedding) / 15) AS BIGINT))) AS p) t)"""
ORACLES["explode_pixels"] = with_(PADDED) + "SELECT image_id, CAST(p // 15 AS INT) AS y, CAST(p % 15 AS INT) AS pos, v FROM padded"
ORACLES["text_raster_rows"] = with_(TEXT) + """SELECT image_id, any_value(h) AS height, y, CAST(sum(CAST(v AS BIGINT) * (x + 1)) AS BIGINT) AS weighted
FROM px GROUP BY image_id, y"""
ORACLES["to_gray"] = with_(PADDED, """
tri AS (SELECT image_id, p // 3 AS px, max(CASE WHEN p % 3 = 0 THEN v END) AS b, max(CASE WHEN p % 3 = 1 THEN v END) AS g, max(CASE WHEN p % 3 = 2 THEN v END) AS r
        FROM padded GROUP BY image_id, p // 3)""") + """
SELECT image_id, CAST(px // 5 AS INT) AS y, CAST(px % 5 AS INT) AS x, CAST(floor(b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE + 0.5::DOUBLE) AS INT) AS v FROM tri"""
ORACLES["minmax_normalise"] = """WITH e AS (SELECT vec_id AS image_id, p - 1 AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) t(p)),
s AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM e GROUP BY image_id)
SELECT image_id, 0 AS y, CAST(x AS INT) AS x, CAST(CASE WHEN hi > lo THEN floor((v - lo) * 255.0::DOUBLE / (hi - lo)) ELSE 0 END AS INT) AS v FROM e JOIN s USING (image_id)"""
ORACLES["raster_rejects"] = """SELECT vec_id AS image_id, CASE WHEN vec_id % 5 = 0 THEN 'no data' WHEN vec_id % 11 = 0 THEN 'unsupported channels'
WHEN vec_id % 7 = 0 THEN 'data does not fit the frame' ELSE 'ok' END AS error FROM embeddings"""
TILE_MASK = [TILES, mask("v BETWEEN 90 AND 210")]
ORACLES["mask_sink"] = with_(*TILE_MASK, runs_cte("r", "m")) + "SELECT image_id, y, x0, x1, image_id || '_mask' AS name FROM r"
TILE_LABELS = [*TILE_MASK, runs_cte("r", "m"), components("f", "r", 4), labels("f")]
ORACLES["label_sink"] = with_(*TILE_LABELS, recursive=True) + "SELECT image_id, y, x0, x1, label, image_id || '_labels' AS name FROM f_label"

RECTS = """o AS (SELECT o_orderkey AS rect_id, 50 AS h, 84 AS w, CAST(o_orderkey % 97 - 8 AS INT) AS x0, CAST(o_orderkey % 61 - 6 AS INT) AS y0,
CAST(o_orderkey % 103 - 4 AS INT) AS x1, CAST(o_orderkey % 67 - 5 AS INT) AS y1 FROM orders)"""


def rect_result(x0, y0, x1, y1):
    names = {"x0": "a", "y0": "b", "x1": "c", "y1": "d"}
    return with_(RECTS, f"r AS (SELECT rect_id, {x0} AS a, {y0} AS b, {x1} AS c, {y1} AS d FROM o)") + "SELECT rect_id, " + ", ".join(
        f"CASE WHEN c > a AND d > b THEN {k} END AS {n}" for n, k in names.items()) + " FROM r"


ORACLES["clamp_rects"] = rect_result(
    "greatest(0, least(x0, w - 1))", "greatest(0, least(y0, h - 1))", "greatest(1, least(x1, w))", "greatest(1, least(y1, h))")
ORACLES["rects_to_margins"] = with_(RECTS) + """SELECT rect_id, greatest(0, x0) AS "left", greatest(0, y0) AS top, greatest(0, w - x1) AS "right",
greatest(0, h - y1) AS bottom FROM o"""
ORACLES["margins_to_rects"] = rect_result("greatest(0, x0)", "greatest(0, y0)", "w - greatest(0, x1)", "h - greatest(0, y1)")
ORACLES["crop_rect"] = with_(LINE, """r AS (SELECT DISTINCT image_id, greatest(0, least(CAST(image_id % 90 - 10 AS INT), 83)) AS a, greatest(0, least(CAST(image_id % 40 AS INT), 49)) AS b,
greatest(1, least(CAST(image_id % 90 + image_id % 13 AS INT), 84)) AS c, greatest(1, least(CAST(image_id % 40 + 9 AS INT), 50)) AS d FROM px)""") + """
SELECT image_id, y - b AS y, x - a AS x, v FROM px JOIN r USING (image_id) WHERE c > a AND d > b AND y >= b AND y < d AND x >= a AND x < c"""
ORACLES["crop_mask"] = with_(*LINE_MASK, "m2 AS (SELECT image_id, y - 5 AS y, x - 7 AS x, h, w, fg FROM m WHERE y BETWEEN 5 AND 40 AND x BETWEEN 7 AND 59)",
                             runs_cte("result", "m2")) + RUNS.format("result")


def text_crop(a, b, c, d, extra=""):
    return with_(TEXT, "f AS (SELECT DISTINCT image_id, h, w FROM px)", extra or "one AS (SELECT 1)",
                 f"r AS (SELECT image_id, {a} AS a, {b} AS b, {c} AS c, {d} AS d FROM f)") + """
SELECT image_id, CAST(any_value(d - b) AS INT) AS height, CAST(any_value(c - a) AS INT) AS width, count(DISTINCT y) AS rows,
CAST(sum(CAST(v AS BIGINT) * (x - a + 1) * (y - b + 1)) AS BIGINT) AS weighted
FROM px JOIN r USING (image_id) WHERE c > a AND d > b AND y >= b AND y < d AND x >= a AND x < c GROUP BY image_id"""


ORACLES["crop_margins"] = text_crop("5", "9", "w - 3", "h - 6")
# Margins of the rectangle (4, 2, 60, 500) clamped to the image with the smallest id.
ORACLES["crop_batch_margins"] = text_crop(
    "4", "(SELECT t FROM base)", "w - 4", "h - (SELECT b FROM base)",
    "base AS (SELECT greatest(0, least(2, h - 1)) AS t, h - greatest(1, least(500, h)) AS b FROM f WHERE image_id = (SELECT min(image_id) FROM f))")
ORACLES["crop_batch_clamp"] = text_crop("4", "greatest(0, least(2, h - 1))", "60", "greatest(1, least(12, h))")
ORACLES["crop_apply_all"] = text_crop(
    *[f"CASE WHEN ok THEN {inside} ELSE {whole} END" for inside, whole in (("10", "0"), ("t", "0"), ("40", "w"), ("h - b", "h"))], extra="""
base AS (SELECT greatest(0, least(20, h - 1)) AS t, h - greatest(1, least(30, h)) AS b, greatest(1, least(30, h)) > greatest(0, least(20, h - 1)) AS good
         FROM f WHERE image_id = (SELECT min(image_id) FROM f)),
f2 AS (SELECT f.*, t, b, good AND h - b > t AS ok FROM f, base)""").replace("AS d FROM f)", "AS d FROM f2)")
# 24 x 31 pixels above 100: scaled by sqrt(100 / 744) to 8 x 11 cells.
ORACLES["preview_downscale"] = with_(EVENT, "sz AS (SELECT 8 AS nh, 11 AS nw, 24 / 8.0::DOUBLE AS sy, 31 / 11.0::DOUBLE AS sx)", """
c AS (SELECT image_id, ty, tx, v, least(y + 1, (ty + 1) * sy) - greatest(y, ty * sy) AS oy, least(x + 1, (tx + 1) * sx) - greatest(x, tx * sx) AS ox, sy * sx AS area
      FROM px, sz, range(8) a(ty), range(11) b(tx) WHERE y + 1 > ty * sy AND y < (ty + 1) * sy AND x + 1 > tx * sx AND x < (tx + 1) * sx)""") + """
SELECT image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, CAST(round_even(sum(v * oy * ox) / any_value(area), 0) AS INT) AS v FROM c GROUP BY image_id, ty, tx"""
ORACLES["resize_nearest"] = with_(EVENT) + """SELECT image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, v FROM px, range(37) a(ty), range(20) b(tx)
WHERE px.y = (ty * 24) // 37 AND px.x = (tx * 31) // 20"""
SMALL = "sv AS (SELECT image_id, y, x, h, w, CASE WHEN image_id % 3 = 0 THEN v ELSE CAST(v > 127 AS INT) END AS v FROM px), top AS (SELECT image_id, max(v) AS t FROM sv GROUP BY image_id)"
ORACLES["mask_normalise"] = with_(TILES, SMALL) + "SELECT image_id, y, x, CASE WHEN t <= 1 THEN v * 255 ELSE v END AS v FROM sv JOIN top USING (image_id)"
ORACLES["bool_mask"] = with_(TILES, SMALL, mask("CASE WHEN t > 1 THEN v >= 128 ELSE v > 0 END", "sv JOIN top USING (image_id)"), runs_cte("r", "m")) + RUNS.format("r")
ORACLES["label_normalise"] = with_(TILES) + "SELECT image_id, y, x, greatest(CAST(trunc((v - 128) * 2.75::DOUBLE) AS INT), 0) AS v FROM px"

# Filters -----------------------------------------------------------------------------------------------------------


def median(source: str, k: int) -> str:
    r = k // 2
    return with_(source, f"d AS (SELECT a.i AS dy, b.i AS dx FROM range({-r}, {r + 1}) a(i), range({-r}, {r + 1}) b(i))") + f"""
SELECT p.image_id, p.y, p.x, list_sort(list(q.v))[{k * k // 2 + 1}] AS v FROM px p CROSS JOIN d JOIN px q
ON q.image_id = p.image_id AND q.y = greatest(0, least(p.h - 1, p.y + d.dy)) AND q.x = greatest(0, least(p.w - 1, p.x + d.dx)) GROUP BY p.image_id, p.y, p.x"""


def blur(k: int, edge: str, source: str = "px", value: str = "v") -> list[str]:
    """CTEs ending in bl(image_id, y, x, v, h, w, g): separable Gaussian of ``value``."""
    r = k // 2
    rows = ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(WEIGHTS[k]))

    def reach(c, n):
        moved = f"p.{c} + wt.d"
        if edge == "replicate":
            return f"greatest(0, least(p.{n} - 1, {moved}))"
        return f"CASE WHEN p.{n} = 1 THEN 0 WHEN {moved} < 0 THEN -({moved}) WHEN {moved} >= p.{n} THEN 2 * (p.{n} - 1) - ({moved}) ELSE {moved} END"

    return [f"wt(d, k) AS (VALUES {rows})",
            f"""bx AS (SELECT p.image_id, p.y, p.x, any_value(p.{value}) AS v0, any_value(p.h) AS h, any_value(p.w) AS w, sum(wt.k * q.{value} ORDER BY wt.d) AS g
    FROM {source} p CROSS JOIN wt JOIN {source} q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {reach('x', 'w')} GROUP BY p.image_id, p.y, p.x)""",
            f"""bl AS (SELECT p.image_id, p.y, p.x, any_value(p.v0) AS v, any_value(p.h) AS h, any_value(p.w) AS w, sum(wt.k * q.g ORDER BY wt.d) AS g
    FROM bx p CROSS JOIN wt JOIN bx q ON q.image_id = p.image_id AND q.x = p.x AND q.y = {reach('y', 'h')} GROUP BY p.image_id, p.y, p.x)"""]


ORACLES["median_filter"] = median(EVENT, 3)
ORACLES["median_filter_wide"] = median(TILES, 5)
ORACLES["gaussian_filter"] = with_(EVENT, *blur(5, "reflect")) + "SELECT image_id, y, x, CAST(floor(g + 0.5) AS INT) AS v FROM bl"
# A tile has 12 pixels and a clip of 1 a bin, so its curve at v counts the distinct values up to v and the share of the excess spread up to v.
ORACLES["clahe"] = with_(EVENT, """
wide AS (SELECT p.image_id, y, CAST(t.x AS INT) AS x, v FROM px p JOIN range(32) t(x) ON p.x = CASE WHEN t.x < 31 THEN t.x ELSE 60 - t.x END),
tile AS MATERIALIZED (SELECT image_id, y // 3 AS ty, x // 4 AS tx, list(DISTINCT v) AS vs, CAST(count(*) - count(DISTINCT v) AS INT) AS ex FROM wide GROUP BY ALL),
pos AS (SELECT image_id, y, x, v, y / 3.0::DOUBLE - 0.5 AS fy, x / 4.0::DOUBLE - 0.5 AS fx FROM px),
spot AS (SELECT *, CAST(floor(fy) AS INT) AS ty, CAST(floor(fx) AS INT) AS tx FROM pos),
near AS (SELECT p.*, dy, dx, least(255, round_even((len(list_filter(t.vs, lambda u: u <= p.v)) + CASE WHEN ex > 0 THEN least(ex, p.v // (256 // ex) + 1) ELSE 0 END)
                * (255.0::DOUBLE / 12), 0)) AS o
         FROM spot p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx)
         JOIN tile t ON t.image_id = p.image_id AND t.ty = greatest(0, least(7, p.ty + dy)) AND t.tx = greatest(0, least(7, p.tx + dx))),
four AS (SELECT image_id, y, x, any_value(fy - ty) AS wy, any_value(fx - tx) AS wx, max(o) FILTER (dy = 0 AND dx = 0) AS a, max(o) FILTER (dy = 0 AND dx = 1) AS b,
         max(o) FILTER (dy = 1 AND dx = 0) AS c, max(o) FILTER (dy = 1 AND dx = 1) AS d FROM near GROUP BY image_id, y, x)""") + """
SELECT image_id, y, x, CAST(floor((a * (1 - wx) + b * wx) * (1 - wy) + (c * (1 - wx) + d * wx) * wy + 0.5) AS INT) AS v FROM four"""


def ellipse_max(k: int, source: str, value: str) -> list[str]:
    """CTEs ending in em(image_id, y, x, h, w, value, top): largest value in the elliptical neighbourhood, by windows."""
    spans = ELLIPSES[k]
    sides = sorted({(-lo, hi) for _, lo, hi in spans})
    along = ", ".join(f"max({value}) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS s{a}_{b}" for a, b in sides)
    down = ", ".join(f"{'lag' if dy < 0 else 'lead'}(s{-lo}_{hi}, {abs(dy)}) OVER c" for dy, lo, hi in spans)
    return [f"ea AS MATERIALIZED (SELECT image_id, y, x, h, w, {value}, {along} FROM {source})",
            f"em AS MATERIALIZED (SELECT image_id, y, x, h, w, {value}, greatest({down}) AS top FROM ea WINDOW c AS (PARTITION BY image_id, x ORDER BY y))"]


ORACLES["local_maxima"] = with_(LINE, *ellipse_max(5, "px", "v"), mask("v = top AND v >= 60", "em"), runs_cte("r", "m")) + RUNS.format("r")


def box(source: str, out: str, fold: str) -> list[str]:
    """3 x 3 fold of a mask by two windows; positions outside the frame are left out."""
    near = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    return [f"{out}_a AS (SELECT image_id, y, x, h, w, {fold}(fg) OVER (PARTITION BY image_id, y ORDER BY x {near}) AS fg FROM {source})",
            f"{out} AS MATERIALIZED (SELECT image_id, y, x, h, w, {fold}(fg) OVER (PARTITION BY image_id, x ORDER BY y {near}) AS fg FROM {out}_a)"]


def boxes(base: list[str], folds: list[str]) -> str:
    parts, source = list(base), "m"
    for n, fold in enumerate(folds):
        parts += box(source, f"s{n}", fold)
        source = f"s{n}"
    return with_(*parts, runs_cte("result", source)) + RUNS.format("result")


ORACLES["morph_open"] = boxes(LINE_DARK, ["bool_and", "bool_or"])
ORACLES["morph_close"] = boxes(LINE_MASK, ["bool_or", "bool_and"])
ORACLES["morph_open_close"] = boxes(LINE_DARK, ["bool_and", "bool_or", "bool_or", "bool_and"])

# Thresholds --------------------------------------------------------------------------------------------------------

ORACLES["gray_histogram"] = with_(LINE, HIST) + "SELECT * FROM hist"
ORACLES["otsu_threshold"] = with_(LINE, OTSU) + "SELECT * FROM otsu"
ORACLES["percentile_threshold"] = with_(TILES) + "SELECT image_id, round(quantile_cont(CAST(v AS DOUBLE), 0.975), 6) AS thresh FROM px GROUP BY image_id"
ORACLES["pick_mask"] = with_(LINE, mask("v BETWEEN 20 AND 100"), runs_cte("r", "m")) + RUNS.format("r")
ORACLES["polarity_choice"] = with_(TILES, OTSU, POLARITY.format(thresholds="otsu"), """mode(polarity) AS (VALUES ('auto'), ('poresDarker'), ('poresBrighter')),
pick AS (SELECT image_id, polarity, a, b, CASE polarity WHEN 'poresDarker' THEN NOT coalesce(a < b, false) WHEN 'poresBrighter' THEN coalesce(a < b, false)
         ELSE coalesce(b < a, false) END AS invert FROM side, mode)""") + """
SELECT image_id, polarity, invert, round(coalesce(abs(a - b), 0.0), 6) AS gap, round(CASE WHEN invert THEN b ELSE a END, 6) AS fg_mean,
round(CASE WHEN invert THEN a ELSE b END, 6) AS bg_mean FROM pick"""
# The values at most the threshold are darker wherever both sides exist.
ORACLES["otsu_mask"] = with_(LINE, OTSU, POLARITY.format(thresholds="otsu"), mask("(v > thresh) <> coalesce(b < a, false)", "px JOIN side USING (image_id)"), runs_cte("r", "m")) + RUNS.format("r")
ORACLES["percentile_mask"] = with_(LINE, "q AS (SELECT image_id, quantile_cont(CAST(v AS DOUBLE), 0.93) AS thresh FROM px GROUP BY image_id)",
                                   mask("v > thresh", "px JOIN q USING (image_id)"), runs_cte("r", "m")) + RUNS.format("r")
ORACLES["adaptive_mask"] = with_(EVENT, *blur(11, "replicate"), "ab AS (SELECT *, v > round_even(g, 0) - 2 AS a FROM bl)",
                                 "side AS (SELECT image_id, avg(v) FILTER (a) AS fa, avg(v) FILTER (NOT a) AS fb FROM ab GROUP BY image_id)",
                                 mask("a <> coalesce(fb < fa, false)", "ab JOIN side USING (image_id)"), runs_cte("r", "m")) + RUNS.format("r")
ORACLES["eyedropper"] = with_(EVENT, "pk AS (SELECT user_id AS image_id, CAST(event_id % 40 - 4 AS INT) AS x, CAST((event_id // 7) % 24 AS INT) AS y FROM events)") + """
SELECT image_id, x, y, v AS pick_value FROM pk JOIN px USING (image_id, y, x)"""
ORACLES["threshold_meta"] = f"""SELECT image_id, 'percentile' AS method, 'auto' AS polarity, CAST(40.0 AS DOUBLE) AS percentile,
round(quantile_cont(CAST(v AS DOUBLE), 0.4), 6) AS thresh FROM ({median(TILES, 3)}) GROUP BY image_id"""

# Masks and components ----------------------------------------------------------------------------------------------

ORACLES["threshold_batch"] = mask_result(filled(LINE_DARK))
ORACLES["runs"] = with_(*LINE_MASK, runs_cte("r", "m")) + RUNS.format("r")
for conn in (4, 8):
    ORACLES[f"components{conn}"] = with_(*LINE_MASK, runs_cte("r", "m"), components("f", "r", conn), labels("f"), recursive=True) + \
        "SELECT image_id, y, x0, x1, label FROM f_label"
ORACLES["fill_holes"] = mask_result(filled(LINE_DARK))
ORACLES["remove_small"] = mask_result(dropped(LINE_MASK, 8, "area < 4"))
ORACLES["clear_border"] = mask_result(dropped(LINE_MASK, 4, "border"))
ORACLES["islands"] = mask_result(dropped(LINE_MASK, 8, "area < 3 AND NOT border"))
ORACLES["small_holes"] = mask_result(filled(LINE_DARK, 5))
SEEDS = "seed AS (SELECT DISTINCT l_suppkey AS image_id, CAST(l_orderkey % 84 AS INT) AS x, CAST(l_partkey % 50 AS INT) AS y FROM lineitem)"


def flooded(base: list[str], source: str, side: str, connectivity: int, where: str) -> str:
    hit = f"EXISTS (SELECT 1 FROM seed s WHERE s.image_id = fl_r.image_id AND s.y = fl_r.y AND s.x >= fl_r.x0 AND s.x < fl_r.x1 AND {where})"
    parts = [*base, SEEDS, runs_cte("fl_r", source, side), f"fl_s AS (SELECT *, {hit} AS hit FROM fl_r)", reached("fl", "fl_s", connectivity, "hit")]
    return mask_result(swapped(parts, "SELECT image_id, y, x0, x1 FROM fl_node WHERE id IN (SELECT id FROM fl_out)", "m2", source))


GROWN = [*LINE_MASK, *box("m", "grown", "bool_or")]
ORACLES["flood_add"] = flooded(GROWN, "grown", "NOT fg", 4, "true")
ORACLES["flood_remove"] = flooded(LINE_MASK, "m", "fg", 8, "true")

STAMPS = """ed AS (SELECT user_id AS image_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'paint' WHEN 'click' THEN 'erase' WHEN 'purchase' THEN 'paint_line'
 WHEN 'signup' THEN 'erase_line' ELSE CASE WHEN event_id % 50 = 0 THEN 'reset' ELSE 'paint' END END AS op, event_id % 37 - 3 AS x, event_id % 29 - 2 AS y,
 event_id % 41 - 5 AS x2, event_id % 23 AS y2, event_id % 5 AS radius FROM events),
en AS (SELECT *, CASE WHEN op LIKE '%line' THEN greatest(1, CAST(floor(greatest(1.0, sqrt(CAST((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS DOUBLE))) / greatest(1, radius // 2)) AS INT)) ELSE 0 END AS n
       FROM ed WHERE op <> 'reset'),
st AS (SELECT image_id, seq, op LIKE 'paint%' AS paint, greatest(1, radius) AS r,
       CASE WHEN n = 0 THEN x WHEN i = n THEN x2 ELSE floor(x + i * (CAST(x2 - x AS DOUBLE) / n)) END AS cx,
       CASE WHEN n = 0 THEN y WHEN i = n THEN y2 ELSE floor(y + i * (CAST(y2 - y AS DOUBLE) / n)) END AS cy FROM en, unnest(range(0, n + 1)) t(i)),
disk AS (SELECT image_id, seq, paint, CAST(cy + dy AS INT) AS y, cx, CAST(floor(sqrt(CAST(r * r - dy * dy AS DOUBLE))) AS INT) AS half FROM st, unnest(range(-r, r + 1)) t(dy)),
sr AS (SELECT image_id, seq, paint, y, CAST(greatest(0, cx - half) AS INT) AS x0, CAST(least(31, cx + half + 1) AS INT) AS x1 FROM disk WHERE y BETWEEN 0 AND 23)"""
ORACLES["brush_stamps"] = with_(STAMPS) + "SELECT image_id, seq, paint, y, x0, x1 FROM sr WHERE x0 < x1"


def replayed(where: str) -> str:
    return with_(EVENT, STAMPS, f"""rs AS (SELECT image_id, max(seq) AS rseq FROM ed WHERE op = 'reset' AND {where} GROUP BY image_id),
ep AS (SELECT image_id, y, unnest(range(x0, x1)) AS x, seq, paint FROM sr WHERE x0 < x1 AND {where}),
lw AS (SELECT image_id, y, x, max(seq) AS seq, arg_max(paint, seq) AS paint FROM ep GROUP BY image_id, y, x),
m AS (SELECT px.image_id, px.y, px.x, h, w, CASE WHEN lw.seq IS NOT NULL AND (rseq IS NULL OR lw.seq > rseq) THEN lw.paint
      WHEN rseq IS NOT NULL THEN false ELSE v BETWEEN 145 AND 255 END AS fg
      FROM px LEFT JOIN rs USING (image_id) LEFT JOIN lw ON lw.image_id = px.image_id AND lw.y = px.y AND lw.x = px.x)""", runs_cte("r", "m")) + RUNS.format("r")


ORACLES["replay_edits"] = replayed("true")
ORACLES["replay_edits_as_of"] = replayed("seq <= 4000")
ORACLES["mask_from_labels"] = ORACLES["pick_mask"]

# Separation --------------------------------------------------------------------------------------------------------

# The nearest background is found per column first: distance along the row to background, then the best row offset.
DIST = [*LINE_DARK, """gx AS (SELECT image_id, y, x, h, w, fg, least(coalesce(x - max(CASE WHEN NOT fg THEN x END) OVER l, 100000), coalesce(min(CASE WHEN NOT fg THEN x END) OVER g - x, 100000)) AS g FROM m
WINDOW l AS (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        """dist AS MATERIALIZED (SELECT a.image_id, a.y, a.x, any_value(a.h) AS h, any_value(a.w) AS w, any_value(a.fg) AS fg,
least(min(CAST(b.g AS BIGINT) * b.g + (a.y - b.y) * (a.y - b.y)), 17956) AS d2 FROM gx a JOIN gx b USING (image_id, x) GROUP BY a.image_id, a.y, a.x)"""]
ORACLES["distance_exact"] = with_(*DIST) + "SELECT image_id, y, x, CAST(d2 AS BIGINT) AS d2 FROM dist"
ORACLES["distance_blur"] = with_(*DIST, "dd AS (SELECT *, sqrt(CAST(d2 AS DOUBLE)) AS d FROM dist)", *blur(3, "reflect", "dd", "d")) + \
    "SELECT image_id, y, x, round(g, 6) AS d FROM bl"
ORACLES["distance_norm"] = with_(*DIST, "dm AS (SELECT image_id, max(sqrt(CAST(d2 AS DOUBLE))) AS t FROM dist GROUP BY image_id)") + """
SELECT image_id, y, x, round(CASE WHEN t > 1e-9 THEN sqrt(CAST(d2 AS DOUBLE)) / t ELSE 0 END, 6) AS n FROM dist JOIN dm USING (image_id)"""
ORACLES["markers"] = with_(*DIST, *ellipse_max(5, "dist", "d2"), "dm AS (SELECT image_id, 0.5 * greatest(max(sqrt(CAST(d2 AS DOUBLE))), 1e-9) AS t FROM dist GROUP BY image_id)",
                           mask("d2 = top AND sqrt(CAST(d2 AS DOUBLE)) >= t", "em JOIN dm USING (image_id)").replace("m AS", "pk AS", 1), runs_cte("r", "pk"), components("f", "r", 8), labels("f"),
                           recursive=True) + "SELECT image_id, y, x0, x1, label FROM f_label"
ORACLES["no_peak_fallback"] = with_(TILES, "hi AS (SELECT DISTINCT image_id FROM px WHERE v >= 230)", """
m AS (SELECT image_id, y, x, h, w, CASE WHEN image_id IN (FROM hi) THEN v >= 230 ELSE v BETWEEN 170 AND 230 END AS fg FROM px)""",
                                    runs_cte("r", "m"), components("f", "r", 8), labels("f"), recursive=True) + "SELECT image_id, y, x0, x1, label FROM f_label"


def flood_keys(start: str) -> list[str]:
    """fk: level, steps and label of every pixel flooded from the seeds of ``start`` (image_id, y, x, h, w, fg, c, seed).

    Levels are smallest largest costs; steps count from where the level last rose; labels run along the steps.
    """
    near = "JOIN cst n ON n.image_id = k.image_id AND n.y = k.y + dy AND n.x = k.x + dx"
    key = "USING KEY (image_id, y, x)"
    return [
        "o4(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1))", f"cst0 AS MATERIALIZED ({start})",
        "cst AS MATERIALIZED (FROM cst0 WHERE image_id IN (SELECT image_id FROM cst0 WHERE seed > 0 GROUP BY image_id HAVING min(seed) < max(seed)))",
        # a single label takes the whole frame
        "one AS (SELECT image_id, min(seed) AS label FROM cst0 WHERE seed > 0 GROUP BY image_id HAVING min(seed) = max(seed))",
        f"""lv(image_id, y, x, l) {key} AS (SELECT image_id, y, x, c FROM cst WHERE seed > 0 UNION
  SELECT b.* FROM (SELECT n.image_id, n.y, n.x, min(greatest(k.l, n.c)) AS l FROM lv k CROSS JOIN o4 {near} GROUP BY ALL) b
  LEFT JOIN recurring.lv r ON r.image_id = b.image_id AND r.y = b.y AND r.x = b.x WHERE b.l < coalesce(r.l, 1000))""",
        "lc AS MATERIALIZED (SELECT cst.*, l FROM cst JOIN lv USING (image_id, y, x))",
        """ent AS (SELECT n.image_id, n.y, n.x FROM lc k CROSS JOIN o4 JOIN lc n ON n.image_id = k.image_id AND n.y = k.y + dy AND n.x = k.x + dx
  WHERE n.seed = 0 AND k.l < n.c GROUP BY ALL)""",
        f"""st(image_id, y, x, l, s) {key} AS (
  SELECT image_id, y, x, l, 0 FROM lc WHERE seed > 0 UNION ALL SELECT image_id, y, x, l, 1 FROM ent JOIN lc USING (image_id, y, x) UNION
  SELECT b.* FROM (SELECT n.image_id, n.y, n.x, n.l, min(k.s + 1) AS s FROM st k CROSS JOIN o4 {near.replace("cst", "lc")} AND n.l = k.l GROUP BY ALL) b
  LEFT JOIN recurring.st r ON r.image_id = b.image_id AND r.y = b.y AND r.x = b.x WHERE b.s < coalesce(r.s, 1000000))""",
        "sc AS MATERIALIZED (SELECT lc.*, s FROM lc JOIN st USING (image_id, y, x))",
        f"""lb(image_id, y, x, l, s, label) {key} AS (SELECT image_id, y, x, l, s, seed FROM sc WHERE seed > 0 UNION
  SELECT b.* FROM (SELECT n.image_id, n.y, n.x, n.l, n.s, min(k.label) AS label FROM lb k CROSS JOIN o4 {near.replace("cst", "sc")}
                   AND CASE WHEN n.l = k.l THEN n.s = k.s + 1 ELSE k.l < n.c AND n.s = 1 AND n.seed = 0 END GROUP BY ALL) b
  LEFT JOIN recurring.lb r ON r.image_id = b.image_id AND r.y = b.y AND r.x = b.x WHERE b.label < coalesce(r.label, 1000000000))""",
        "fk AS MATERIALIZED (SELECT cst.*, lb.l, lb.s, lb.label FROM cst JOIN lb USING (image_id, y, x) UNION ALL SELECT cst0.*, 0, 0, one.label FROM cst0 JOIN one USING (image_id))"]


def split_pores(base: list[str], lines: bool, min_distance: int = 3, rel: float = 0.2, source: str = "m") -> list[str]:
    """ws: label runs of the pores of ``source``, split from blurred distances (``min_distance`` and ``rel`` pick the peaks)."""
    cut = """AND NOT EXISTS (SELECT 1 FROM o4 JOIN fk k ON k.image_id = f.image_id AND k.y = f.y + dy AND k.x = f.x + dx
             WHERE k.label <> f.label AND (k.l, k.s, k.label) < (f.l, f.s, f.label)) AND f.x > 0 AND f.x < f.w - 1 AND f.y > 0 AND f.y < f.h - 1"""
    return [
        *base, *[p.replace("FROM m\n", f"FROM {source}\n") for p in DIST[len(LINE_DARK):]], "dd AS (SELECT *, sqrt(CAST(d2 AS DOUBLE)) AS d FROM dist)", *blur(3, "reflect", "dd", "d"),
        f"bd AS MATERIALIZED (SELECT bl.image_id, bl.y, bl.x, m.h, m.w, m.fg, g FROM bl JOIN {source} m USING (image_id, y, x))",
        "bm AS (SELECT image_id, max(g) AS t FROM bd GROUP BY image_id)", *ellipse_max(min_distance, "bd", "g"),
        mask(f"g = top AND g >= {rel}::DOUBLE * greatest(t, 1e-9::DOUBLE)", "em JOIN bm USING (image_id)").replace("m AS", "pk AS", 1),
        runs_cte("pr", "pk"), components("pf", "pr", 8), labels("pf"),
        "pl AS (SELECT image_id, y, CAST(unnest(range(x0, x1)) AS INT) AS x, label FROM pf_label)",
        *flood_keys("""SELECT image_id, y, x, h, w, fg, CAST(255 - floor(CASE WHEN t > 1e-9::DOUBLE THEN g / t ELSE 0.0::DOUBLE END * 255) AS INT) AS c,
  CASE WHEN fg THEN coalesce(label, 0) ELSE 0 END AS seed FROM bd JOIN bm USING (image_id) LEFT JOIN pl USING (image_id, y, x)"""),
        f"wl AS (SELECT image_id, y, x, label FROM fk f WHERE fg {cut if lines else ''})",
        """ws AS (SELECT image_id, y, min(x) AS x0, CAST(max(x) + 1 AS INT) AS x1, label FROM (
  SELECT *, x - row_number() OVER (PARTITION BY image_id, y, label ORDER BY x) AS run FROM wl) GROUP BY image_id, y, label, run)"""]


SPLIT_RESULT = "SELECT image_id, y, x0, x1, CAST(label AS INT) AS label FROM ws"
ORACLES["watershed"] = with_(*split_pores(LINE_MASK, True), recursive=True) + SPLIT_RESULT
ORACLES["watershed_without_lines"] = with_(*split_pores(LINE_MASK, False), recursive=True) + SPLIT_RESULT
# The whole study: 3 x 3 median, Otsu, holes, specks of fewer than 3 pixels, split, small labels dropped and the rest numbered.
SEGMENTED = split_pores([
    LINE.replace("px AS", "raw AS"), """
row3 AS (SELECT image_id, y, x, h, w, [coalesce(lag(v) OVER a, v), v, coalesce(lead(v) OVER a, v)] AS t FROM raw WINDOW a AS (PARTITION BY image_id, y ORDER BY x)),
px AS MATERIALIZED (SELECT image_id, y, x, h, w, list_sort(coalesce(lag(t) OVER c, t) || t || coalesce(lead(t) OVER c, t))[5] AS v
  FROM row3 WINDOW c AS (PARTITION BY image_id, x ORDER BY y))""",
    *filled([OTSU, mask("v > thresh", "px JOIN otsu USING (image_id)")]), runs_cte("r3", "m2"), components("k3", "r3", 8),
    "big AS (SELECT image_id, y, CAST(unnest(range(x0, x1)) AS INT) AS x FROM k3_comp JOIN k3_fact USING (image_id, c) WHERE area >= 3)",
    "clean AS MATERIALIZED (SELECT m2.* REPLACE (big.x IS NOT NULL AS fg) FROM m2 LEFT JOIN big USING (image_id, y, x))"], True, source="clean")
SEGMENTED += ["""f_label AS MATERIALIZED (SELECT ws.image_id, y, x0, x1, nw AS label, 50 AS h, 84 AS w FROM ws JOIN (
  SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INT) AS nw FROM ws GROUP BY image_id, label HAVING sum(x1 - x0) >= 3
  ) n USING (image_id, label))"""]
ORACLES["pipeline_segment"] = with_(*SEGMENTED, recursive=True) + "SELECT image_id, y, x0, x1, label FROM f_label"
ORACLES["post_cleanup"] = with_(*LINE_LABELS, """
lf AS (SELECT image_id, label, sum(x1 - x0) AS area, bool_or(y = 0 OR y = h - 1 OR x0 = 0 OR x1 = w) AS border FROM f_label GROUP BY image_id, label),
nl AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INT) AS nw FROM lf WHERE area >= 2 AND NOT border)""", recursive=True) + """
SELECT image_id, y, x0, x1, nw AS label FROM f_label JOIN nl USING (image_id, label)"""
ORACLES["pipeline_mask"] = mask_result([*filled(LINE_MASK), runs_cte("r3", "m2"), components("k3", "r3", 8), """
keep AS (SELECT image_id, y, CAST(unnest(range(x0, x1)) AS INT) AS x, h, w, true AS fg FROM k3_comp JOIN k3_fact USING (image_id, c) WHERE area >= 3 AND NOT border)"""], "keep")

# Measurements ------------------------------------------------------------------------------------------------------

BASIC = """basic AS (SELECT image_id, label, CAST(sum(x1 - x0) AS BIGINT) AS area_px, CAST(sum((x0 + x1 - 1) * (x1 - x0)) AS DOUBLE) / 2 / sum(x1 - x0) AS centroid_x,
CAST(sum(y * (x1 - x0)) AS DOUBLE) / sum(x1 - x0) AS centroid_y, min(x0) AS bbox_x0, min(y) AS bbox_y0, max(x1) AS bbox_x1, max(y) + 1 AS bbox_y1,
bool_or(x0 = 0 OR y = 0 OR x1 >= w OR y + 1 >= h) AS touches_border FROM f_label GROUP BY image_id, label)"""
ORACLES["areas"] = with_(*LINE_LABELS, BASIC, recursive=True) + "SELECT image_id, label, area_px, round(sqrt(4.0 * area_px / pi()), 6) AS eq_diam_px FROM basic"
ORACLES["bbox_centroid"] = with_(*LINE_LABELS, BASIC, recursive=True) + "SELECT * REPLACE (round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y) FROM basic"

# Outline: fill each label inside its own box, padded by one pixel, then look at pixels and 2 x 2 windows.
OUTLINE = [*LINE_LABELS, BASIC, """
lp AS (SELECT image_id, label, y, CAST(unnest(range(x0, x1)) AS INT) AS x FROM f_label),
pad AS (SELECT b.image_id * 100000 + b.label AS image_id, a.y, c.x, bbox_x1 - bbox_x0 + 2 AS w, bbox_y1 - bbox_y0 + 2 AS h, lp.x IS NOT NULL AS fg
        FROM basic b, unnest(range(0, bbox_y1 - bbox_y0 + 2)) a(y), unnest(range(0, bbox_x1 - bbox_x0 + 2)) c(x)
        LEFT JOIN lp ON lp.image_id = b.image_id AND lp.label = b.label AND lp.y = a.y + bbox_y0 - 1 AND lp.x = c.x + bbox_x0 - 1)""",
           runs_cte("br", "pad", "NOT fg"), components("bk", "br", 4), """
hole AS (SELECT image_id, y, CAST(unnest(range(x0, x1)) AS INT) AS x FROM bk_comp JOIN bk_fact USING (image_id, c) WHERE NOT border),
solid AS MATERIALIZED (SELECT image_id, y, x FROM pad WHERE fg UNION ALL SELECT image_id, y, x FROM hole)"""]
STEPS = [*OUTLINE, """
quad AS (SELECT image_id, y - dy AS qy, x - dx AS qx, sum(CASE WHEN dy = dx THEN 1 ELSE 0 END) AS diag, count(*) AS n FROM solid, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx) GROUP BY ALL),
per AS (SELECT image_id // 100000 AS image_id, CAST(image_id % 100000 AS INT) AS label, sum(CASE WHEN n = 2 AND diag = 1 THEN 1 ELSE 0 END) AS straight,
        sum(CASE WHEN n = 3 THEN 1 WHEN n = 2 AND diag <> 1 THEN 2 ELSE 0 END) AS slanted FROM quad GROUP BY ALL)"""]
ORACLES["perimeter"] = with_(*STEPS, recursive=True) + "SELECT image_id, label, round(straight + sqrt(2.0) * slanted, 6) AS perimeter_px FROM per"
ORACLES["circularity"] = with_(*STEPS, recursive=True) + """
SELECT image_id, label, round(CASE WHEN straight + slanted > 0 THEN 4 * pi() * area_px / ((straight + sqrt(2.0) * slanted) * (straight + sqrt(2.0) * slanted)) ELSE -1 END, 6) AS circularity
FROM basic JOIN per USING (image_id, label)"""
VISITS = [*OUTLINE, """
o8(dy, dx) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
nb AS (SELECT s.image_id, s.y, s.x, coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = -1 AND dx = 0), 0) AS n, coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = 1 AND dx = 0), 0) AS s,
       coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = 0 AND dx = -1), 0) AS w, coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = 0 AND dx = 1), 0) AS e,
       coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = -1 AND dx = -1), 0) AS nw, coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = -1 AND dx = 1), 0) AS ne,
       coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = 1 AND dx = -1), 0) AS sw, coalesce(max(1) FILTER (q.x IS NOT NULL AND dy = 1 AND dx = 1), 0) AS se
       FROM solid s CROSS JOIN o8 LEFT JOIN solid q ON q.image_id = s.image_id AND q.y = s.y + o8.dy AND q.x = s.x + o8.dx GROUP BY s.image_id, s.y, s.x),
corner AS (SELECT image_id, y, x, unnest([{'h': w, 'v': n, 'd': nw}, {'h': e, 'v': n, 'd': ne}, {'h': w, 'v': s, 'd': sw}, {'h': e, 'v': s, 'd': se}]) AS k,
           n + s + w + e + nw + ne + sw + se AS around FROM nb),
-- Ends of outline steps at a pixel, per 2 x 2 window that holds it: a straight or slanted step has one, a bare diagonal two.
ends AS (SELECT image_id, y, x, CASE WHEN any_value(around) = 0 THEN 2 ELSE sum(CASE k.h + k.v WHEN 1 THEN 1 WHEN 0 THEN 2 * k.d ELSE 0 END) END AS e FROM corner GROUP BY image_id, y, x),
visit AS (SELECT b.image_id, b.label, CAST(ends.y + bbox_y0 - 1 AS INT) AS y, CAST(ends.x + bbox_x0 - 1 AS INT) AS x, CAST(e // 2 AS INT) AS visits
          FROM ends JOIN basic b ON b.image_id = ends.image_id // 100000 AND b.label = ends.image_id % 100000 WHERE e > 0)"""]
ORACLES["outline_points"] = with_(*VISITS, recursive=True) + "SELECT * FROM visit"
ORACLES["pca_axes"] = with_(*VISITS, """
mo AS (SELECT image_id, label, sum(visits) AS n, CAST(sum(visits * x) AS DOUBLE) AS sx, CAST(sum(visits * y) AS DOUBLE) AS sy, CAST(sum(visits * x * x) AS DOUBLE) AS sxx,
       CAST(sum(visits * x * y) AS DOUBLE) AS sxy, CAST(sum(visits * y * y) AS DOUBLE) AS syy FROM visit GROUP BY image_id, label HAVING sum(visits) <= 4),
cv AS (SELECT image_id, label, n, sxx / n - sx / n * sx / n AS a, sxy / n - sx / n * sy / n AS b, syy / n - sy / n * sy / n AS c FROM mo)""", recursive=True) + """
SELECT image_id, label, CASE WHEN n > 1 THEN round(4 * sqrt(greatest((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 0)), 6) END AS major_axis_px,
CASE WHEN n > 1 THEN round(4 * sqrt(greatest(round((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 9), 0)), 6) END AS minor_axis_px,
CASE WHEN n > 1 THEN round((degrees(atan2(2 * b, a - c) / 2) + 360) % 180, 6) END AS orientation_deg FROM cv"""
ORACLES["feret_max"] = with_(*LINE_LABELS, """
ex AS (SELECT image_id, label, y, min(x0) AS lo, max(x1) - 1 AS hi FROM f_label GROUP BY ALL),
pt AS (SELECT image_id, label, y, lo AS x FROM ex UNION SELECT image_id, label, y, hi FROM ex)""", recursive=True) + """
SELECT a.image_id, a.label, round(sqrt(CAST(max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS DOUBLE)), 6) AS feret_max_px
FROM pt a JOIN pt b USING (image_id, label) GROUP BY a.image_id, a.label HAVING count(*) > 1"""

# Every pair of points with all points on one side is an edge of the hull; the rectangle of smallest area (then side) counts.
ORACLES["feret_min"] = with_(*LINE_LABELS, """
ex AS (SELECT image_id, label, y, min(x0) AS lo, max(x1) - 1 AS hi FROM f_label GROUP BY ALL),
pt AS MATERIALIZED (SELECT image_id, label, y, lo AS x FROM ex UNION SELECT image_id, label, y, hi FROM ex),
pair AS (SELECT a.image_id, a.label, a.y, a.x, CAST(b.y - a.y AS BIGINT) AS dy, CAST(b.x - a.x AS BIGINT) AS dx
         FROM pt a JOIN pt b ON a.image_id = b.image_id AND a.label = b.label AND (a.y, a.x) <> (b.y, b.x)),
side AS (SELECT p.image_id, p.label, p.dy, p.dx, min(p.dy * (c.x - p.x) - p.dx * (c.y - p.y)) AS least, max(p.dy * (c.x - p.x) - p.dx * (c.y - p.y)) AS across,
                max(p.dy * (c.y - p.y) + p.dx * (c.x - p.x)) - min(p.dy * (c.y - p.y) + p.dx * (c.x - p.x)) AS along
         FROM pair p JOIN pt c ON c.image_id = p.image_id AND c.label = p.label GROUP BY p.image_id, p.label, p.y, p.x, p.dy, p.dx),
rect AS (SELECT image_id, label, CAST(along * across AS DOUBLE) / (dy * dy + dx * dx) AS area, least(along, across) / sqrt(CAST(dy * dy + dx * dx AS DOUBLE)) AS shorter
         FROM side WHERE least >= 0)""", recursive=True) + """
SELECT image_id, label, round(arg_min(shorter, (area, shorter)), 6) AS feret_min_px FROM rect GROUP BY image_id, label"""

SCALES = """sc AS (SELECT s_suppkey AS image_id, CASE WHEN s_suppkey % 7 = 0 THEN 0.0::DOUBLE ELSE (s_suppkey % 5 + 1) / 100.0::DOUBLE END AS u,
CASE WHEN s_suppkey % 2 = 0 THEN 'mm' ELSE 'um' END AS unit_name FROM supplier WHERE s_suppkey % 3 <> 0)"""
ORACLES["scaled_measures"] = with_(*LINE_LABELS, BASIC, SCALES, recursive=True) + """
SELECT image_id, label, u AS units_per_px, unit_name, CASE WHEN u > 0 THEN round(area_px * (u * u), 6) END AS area_units2,
CASE WHEN u > 0 THEN round(sqrt(4.0 * area_px / pi()) * u, 6) END AS eq_diam_units,
CASE WHEN u > 0 AND bbox_x1 - bbox_x0 > 1 THEN round((bbox_x1 - bbox_x0 - 1) * u, 6) END AS major_axis_units,
CASE WHEN u > 0 AND bbox_x1 - bbox_x0 > 1 THEN round((bbox_x1 - bbox_x0 - 1) * u, 6) END AS feret_min_units FROM basic LEFT JOIN sc USING (image_id)"""
ORACLES["measurements_csv"] = with_(*LINE_LABELS, BASIC, SCALES, recursive=True) + """
SELECT image_id AS image_index, label, area_px, bbox_x0, bbox_y0, bbox_x1, bbox_y1, touches_border, unit_name FROM basic LEFT JOIN sc USING (image_id)"""

# Calibration -------------------------------------------------------------------------------------------------------

ORACLES["calibrate_two_point"] = """SELECT s_suppkey AS image_id, CASE WHEN s_acctbal / 100 > 0 THEN round(s_acctbal / 100 / greatest(CAST(abs(s_suppkey * 7 % 53 - s_suppkey % 40) AS DOUBLE), 1e-9), 6) END AS units_per_px,
CASE WHEN s_suppkey % 4 = 1 THEN 'um' ELSE 'mm' END AS unit_name FROM supplier"""
ORACLES["manual_scale"] = """SELECT s_suppkey AS image_id, CASE WHEN s_acctbal > 0 THEN round(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE 1.0::DOUBLE / s_acctbal END, 6) END AS units_per_px,
'um' AS unit_name FROM supplier"""
ORACLES["set_scale"] = """WITH ev AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS image_id, CAST(o_orderkey % 9 + 1 AS DOUBLE) AS u,
CASE WHEN o_orderkey % 2 = 0 THEN 'mm' ELSE 'um' END AS unit_name FROM orders),
al AS (SELECT c_custkey AS image_id, ev.seq, ev.u, ev.unit_name FROM customer JOIN ev ON ev.image_id = c_custkey
       UNION ALL SELECT c_custkey, l.seq, l.u, l.unit_name FROM customer, (SELECT * FROM ev WHERE image_id IS NULL ORDER BY seq DESC LIMIT 1) l)
SELECT image_id, arg_max(u, seq) AS units_per_px, arg_max(unit_name, seq) AS unit_name FROM al GROUP BY image_id"""
ORACLES["common_unit"] = with_(SCALES) + """SELECT CASE WHEN min(unit_name) = max(unit_name) THEN min(unit_name) END AS unit_name, 'even' AS scope FROM sc WHERE image_id % 2 = 0
UNION ALL SELECT CASE WHEN min(unit_name) = max(unit_name) THEN min(unit_name) END, 'all' FROM sc"""

# Analysis ----------------------------------------------------------------------------------------------------------

SIMPLE = [*LINE_LABELS, BASIC, SCALES, """
sp AS (SELECT image_id AS image_index, label, area_px, touches_border, sqrt(4.0 * area_px / pi()) AS eq, CAST(bbox_x1 - bbox_x0 AS DOUBLE) AS bw, CAST(bbox_y1 - bbox_y0 AS DOUBLE) AS bh,
       CASE WHEN u > 0 THEN u END AS u FROM basic LEFT JOIN sc USING (image_id))"""]
SIMPLE_MM = [*LINE_LABELS, BASIC, SCALES.replace("s_suppkey % 3 <> 0", "s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0"), SIMPLE[-1]]
ORACLES["pore_filter"] = with_(*SIMPLE, recursive=True) + """SELECT image_index, label, area_px FROM sp WHERE NOT touches_border
AND area_px BETWEEN 2 AND 6"""
ORACLES["pore_filter_units"] = with_(*SIMPLE_MM, recursive=True) + """SELECT image_index, label, area_px FROM sp WHERE NOT touches_border
AND coalesce(area_px * (u * u), area_px) BETWEEN 0.0004 AND 6.0"""
ORACLES["pore_scope"] = with_(*SIMPLE, recursive=True) + "SELECT image_index, label, area_px FROM sp WHERE image_index = 7 AND area_px >= 2"
METRIC_VALUES = """
mv AS (SELECT image_index, label, 'eq_diam' AS metric, eq * coalesce(u, 1) AS value FROM sp UNION ALL SELECT image_index, label, 'area', coalesce(area_px * (u * u), area_px) FROM sp
UNION ALL SELECT image_index, label, 'circularity', bw / bh FROM sp WHERE area_px > 1
UNION ALL SELECT image_index, label, n, bw * coalesce(u, 1) FROM sp, (VALUES ('feret_max'), ('major_axis')) t(n) WHERE area_px > 1
UNION ALL SELECT image_index, label, n, bh * coalesce(u, 1) FROM sp, (VALUES ('feret_min'), ('minor_axis')) t(n) WHERE area_px > 1)"""
IN_PIXELS = SIMPLE[-1].replace("CASE WHEN u > 0 THEN u END", "CAST(NULL AS DOUBLE)")
for name, parts in (("metric_values", [*SIMPLE[:-1], IN_PIXELS]), ("metric_values_units", SIMPLE_MM)):
    ORACLES[name] = with_(*parts, METRIC_VALUES, recursive=True) + "\nSELECT image_index, label, metric, round(value, 6) AS value FROM mv"


def hist_sql(bins: int, columns: str) -> str:
    return f"""ext AS (SELECT metric, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS a, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS b FROM vals GROUP BY metric),
ct AS (SELECT metric, least(CAST(floor((value - a) / ((b - a) / {bins})) AS INT), {bins - 1}) AS bin, count(*) AS n FROM vals JOIN ext USING (metric) GROUP BY ALL),
gr AS (SELECT metric, CAST(t.bin AS INT) AS bin, a + t.bin * ((b - a) / {bins}) AS lo, a + (t.bin + 1) * ((b - a) / {bins}) AS hi FROM ext, range({bins}) t(bin))
SELECT gr.metric, gr.bin, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(n, 0) AS n{columns} FROM gr LEFT JOIN ct ON ct.metric = gr.metric AND ct.bin = gr.bin"""


ORACLES["histogram"] = with_(*SIMPLE, """vals AS (SELECT 'area' AS metric, CAST(area_px AS DOUBLE) AS value FROM sp UNION ALL SELECT 'circularity', bw / bh FROM sp WHERE area_px > 1
UNION ALL SELECT 'feret_max', bw FROM sp WHERE area_px > 1)""", recursive=True).rstrip() + ",\n" + hist_sql(12, ", round(CASE WHEN n > 0 THEN log10(n) END, 6) AS log_n")
ORACLES["pore_size_distribution"] = with_(*SIMPLE, "vals AS (SELECT 'eq_diam' AS metric, eq AS value FROM sp)", recursive=True).rstrip() + ",\n" + hist_sql(20, "")
ORACLES["pore_table"] = with_(*SIMPLE, recursive=True) + """
SELECT image_index, label, area_px, format('{:.3f}', eq) AS eq_diam_px, CASE WHEN area_px > 1 THEN format('{:.3f}', bw / bh) ELSE 'nan' END AS circularity,
CASE WHEN area_px > 1 THEN format('{:.3f}', bw) ELSE '' END AS feret_max_px, CASE WHEN area_px > 1 THEN format('{:.3f}', bh) ELSE '' END AS feret_min_px,
CASE WHEN area_px > 1 THEN format('{:.3f}', bw) ELSE '' END AS major_axis_px, CASE WHEN area_px > 1 THEN format('{:.3f}', bh) ELSE '' END AS minor_axis_px, '' AS aspect_ratio,
CASE WHEN area_px % 2 = 0 AND area_px % 4 <> 0 THEN format('{:.1f}', area_px * 0.25::DOUBLE) WHEN area_px % 4 = 0 THEN format('{:.1f}', area_px * 0.25::DOUBLE)
ELSE format('{:.1f}', floor(area_px * 2.5::DOUBLE + 0.5) / 10) END AS orientation_deg, CASE WHEN touches_border THEN 'yes' ELSE 'no' END AS border FROM sp"""
ORACLES["labelled_count"] = with_(TILES) + """SELECT count(DISTINCT image_id) FILTER (v >= 230) AS labelled, count(DISTINCT image_id) AS total FROM px"""

# Rendering ---------------------------------------------------------------------------------------------------------

COLOURED = [*TILE_LABELS, """
lab AS (SELECT image_id, y, CAST(unnest(range(x0, x1)) AS INT) AS x, label FROM f_label),
seen AS (SELECT DISTINCT image_id FROM f_label),
cp AS (SELECT px.*, coalesce(label, 0) AS label, px.image_id IN (FROM seen) AS has FROM px LEFT JOIN lab ON lab.image_id = px.image_id AND lab.y = px.y AND lab.x = px.x)"""]


def channel(name: str, factor: int) -> str:
    colour = f"CAST(label AS BIGINT) * {factor} % 256"
    return f"CAST(CASE WHEN has THEN round_even({colour} * 0.45::DOUBLE + v * 0.55::DOUBLE, 0) ELSE v END AS INT) AS {name}"


ORACLES["colour_labels"] = with_(*COLOURED, recursive=True) + "SELECT image_id, y, x, " + ", ".join(
    channel(n, f) for n, f in (("b", 40503), ("g", 30011), ("r", 20021))) + " FROM cp"
ORACLES["colour_labels_plain"] = with_(*COLOURED, recursive=True) + "SELECT image_id, y, x, " + ", ".join(
    f"CAST(CAST(label AS BIGINT) * {f} % 256 AS INT) AS {n}" for n, f in (("b", 40503), ("g", 30011), ("r", 20021))) + " FROM cp"
HUES = [*COLOURED, """
hl AS (SELECT image_id, label, (CAST(label AS BIGINT) * 2654435761 + (image_id % 2147483648 + 123) * 40503) % 4294967296 AS h FROM (SELECT DISTINCT image_id, label FROM f_label)),
hr AS (SELECT image_id, label, floor((row_number() OVER (PARTITION BY image_id ORDER BY h, label) - 1) * 179::DOUBLE / count(*) OVER (PARTITION BY image_id)) AS hue FROM hl),
hs AS (SELECT image_id, label, floor(hue / 30) AS s, hue / 30 - floor(hue / 30) AS f, 255 * (1 - 200 / 255::DOUBLE) AS low FROM hr),
hv AS (SELECT image_id, label, s, low, 255 * (1 - 200 / 255::DOUBLE * f) AS fall, 255 * (1 - 200 / 255::DOUBLE * (1 - f)) AS rise FROM hs),
hc AS (SELECT image_id, label, round_even(CASE s WHEN 0 THEN low WHEN 1 THEN low WHEN 2 THEN rise WHEN 3 THEN 255 WHEN 4 THEN 255 ELSE fall END, 0) AS tb,
       round_even(CASE s WHEN 0 THEN rise WHEN 1 THEN 255 WHEN 2 THEN 255 WHEN 3 THEN fall ELSE low END, 0) AS tg,
       round_even(CASE s WHEN 0 THEN 255 WHEN 1 THEN fall WHEN 2 THEN low WHEN 3 THEN low WHEN 4 THEN rise ELSE 255 END, 0) AS tr FROM hv)"""]
ORACLES["colour_hues"] = with_(*HUES, recursive=True) + "SELECT cp.image_id, y, x, " + ", ".join(
    f"CAST(CASE WHEN t{n} IS NULL THEN v ELSE round_even(t{n} * 0.45::DOUBLE + v * 0.55::DOUBLE, 0) END AS INT) AS {n}" for n in "bgr") + \
    " FROM cp LEFT JOIN hc ON hc.image_id = cp.image_id AND hc.label = cp.label"
ORACLES["mask_overlay"] = with_(TILES, "o AS (SELECT *, CAST(CASE WHEN v BETWEEN 90 AND 210 THEN round_even(255 * 0.45::DOUBLE + v * 0.55::DOUBLE, 0) ELSE v END AS INT) AS t FROM px)") + \
    "SELECT image_id, y, x, v AS b, t AS g, t AS r FROM o"
ORACLES["mask_overlay_tint"] = with_(TILES, "o AS (SELECT *, v BETWEEN 225 AND 235 AS fg, bool_or(v BETWEEN 225 AND 235) OVER (PARTITION BY image_id) AS has FROM px)") + "SELECT image_id, y, x, " + ", ".join(
    f"CAST(CASE WHEN has THEN round_even(CASE WHEN fg THEN {t} ELSE 0 END * 0.45::DOUBLE + v * 0.55::DOUBLE, 0) ELSE v END AS INT) AS {n}" for n, t in (("b", 255), ("g", 80), ("r", 255))) + " FROM o"

# Orchestration -----------------------------------------------------------------------------------------------------

ORACLES["apply_scope"] = with_(TILES, mask("CASE WHEN image_id = 17 THEN v BETWEEN 190 AND 250 ELSE v BETWEEN 90 AND 210 END"), runs_cte("r", "m")) + RUNS.format("r")
ORACLES["apply_to_all"] = with_(TILES, mask("CASE WHEN image_id % 3 = 1 THEN v BETWEEN 190 AND 250 ELSE v BETWEEN 90 AND 210 END"), runs_cte("r", "m")) + RUNS.format("r")
