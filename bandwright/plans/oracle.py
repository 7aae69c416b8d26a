"""DuckDB SQL for the registered queries, written from the definitions on long tables rather than from the Spark plans."""

from __future__ import annotations

from bandwright.functions.scales import LOUDNESS

SCAN = "SELECT p_partkey AS track_id, '/parts/' || p_partkey AS fname, p_name AS title, p_brand AS artist, p_type AS album, p_size AS track, p_size * 37 AS length FROM part"
_PAD = "CASE WHEN p_size < 10 THEN '0' || p_size ELSE CAST(p_size AS VARCHAR) END"
_SHOWN = f"CASE WHEN coalesce(p_name, '') = '' THEN '/parts/' || p_partkey WHEN coalesce(p_brand, '') <> '' AND coalesce(p_type, '') <> '' THEN {_PAD} || ' - ' || p_name ELSE p_name END"
_ROWS = f"SELECT p_partkey AS track_id, {_SHOWN} AS title, coalesce(nullif(p_brand, ''), 'Various') AS artist, coalesce(nullif(p_type, ''), 'Single') AS album FROM part"
DISPLAY = f"SELECT p_partkey AS track_id, {_SHOWN} AS shown FROM part"
TRACK_PAD = f"SELECT p_partkey AS track_id, {_PAD} AS track, printf('%02d:%02d', (p_size * 37) // 60, (p_size * 37) % 60) AS elapsed FROM part"
STRIP = rf"SELECT p_partkey AS track_id, regexp_replace({_SHOWN}, '^\d\d - ', '') AS title, p_name || ' by ' || p_brand || ' (' || p_type || ')' AS label FROM part"
BROWSE = f"SELECT artist, album, count(*) AS n, string_agg(title, '|' ORDER BY title) AS titles FROM ({_ROWS}) GROUP BY artist, album"
LOOKUP_PATH = "SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist, p_type AS album, p_size AS track FROM part WHERE p_partkey = 7"


def search(field: str, text: str) -> str:
    fields = ("artist", "album", "title") if field == "all" else (field,)
    hit = " OR ".join(f"contains({f}, '{text}')" for f in fields)
    return f"SELECT * FROM (SELECT track_id, lower(title) AS title, lower(artist) AS artist, lower(album) AS album FROM ({_ROWS})) WHERE {hit}"


def lookup(names: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"SELECT pos, name, min(p_partkey) AS track_id FROM (VALUES {rows}) AS t(pos, name) LEFT JOIN part ON p_name = name GROUP BY pos, name"


SUFFIX = """SELECT * FROM (SELECT page_id, ext, ext = 'html' AND contains(url, '.') AS exact, starts_with('html', ext) OR starts_with(ext, 'html') AS prefix
FROM (SELECT page_id, url, lower(regexp_replace(url, '^.*[.]', '')) AS ext FROM pages)) WHERE exact OR prefix"""
STEM = r"SELECT page_id, coalesce(regexp_extract(url, '([^/]+?)([.][^./]*)?$', 1), '') AS stem FROM pages"
ANTIJOIN = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
PRUNE = "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"
APPEND = "SELECT c_custkey AS track_id, c_name AS title FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), s_name FROM supplier"
SPLIT = """SELECT track_id, CAST(least(k // greatest(1, n // 7), 6) AS INTEGER) AS part
FROM (SELECT p_partkey AS track_id, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS n FROM part)"""

# Frames of users and days


def _days(loud: float) -> str:
    return f"""cell AS (SELECT track_id, frame_no, band, coalesce(sum(value) FILTER (WHERE kind = event_type AND value > {loud}), 0) / 1000 AS v
FROM (SELECT user_id AS track_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS frame_no, event_type, value FROM events),
(VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) AS k(band, kind) GROUP BY ALL)"""


_LOUD = f"{_days(150.0)}, loud AS (SELECT track_id, frame_no, sum(v) AS total FROM cell GROUP BY ALL HAVING max(v) > 0)"
_COUNTS = f"""{_LOUD}, binned AS (SELECT track_id, band, CAST(floor(least(greatest(v, 0), 1 - 1e0 / 16) * 16) AS INTEGER) AS bin, count(*) AS c FROM cell JOIN loud USING (track_id, frame_no) GROUP BY ALL),
grid AS (SELECT track_id, band, bin FROM (SELECT DISTINCT track_id FROM loud), range(5) AS b(band), range(16) AS k(bin)),
counts AS (SELECT track_id, CAST(band AS INTEGER) AS band, CAST(bin AS INTEGER) AS bin, coalesce(c, 0) AS count FROM grid LEFT JOIN binned USING (track_id, band, bin))"""
SILENT = f"WITH {_LOUD} SELECT track_id, frame_no, round(total, 6) AS total FROM loud"
MIN_EVIDENCE = f"WITH {_LOUD} SELECT track_id, count(*) AS n FROM loud GROUP BY track_id HAVING count(*) >= 5"
HIST_COUNTS = f"WITH {_COUNTS} SELECT * FROM counts"
HIST_NORM = f"WITH {_COUNTS} SELECT track_id, band, bin, round(count / sum(count) OVER (PARTITION BY track_id, band), 6) AS p FROM counts WHERE track_id IN (SELECT track_id FROM loud GROUP BY track_id HAVING count(*) >= 5)"
RATE_AVG = "SELECT user_id AS track_id, CAST(floor(sum(CAST(floor(value * 100) AS BIGINT) * length(props)) / sum(length(props))) AS BIGINT) AS rate FROM events GROUP BY user_id"

# Histograms and distances

_RAW = """raw AS (SELECT vec_id AS track_id, (i - 1) // 16 AS band, (i - 1) % 16 AS bin, abs(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) AS t(i)),
hist AS (SELECT track_id, band, bin, a / nullif(sum(a) OVER (PARTITION BY track_id, band), 0) AS p FROM raw)"""
_SMOOTHED = f"{_RAW}, h AS (SELECT track_id, band, bin, greatest(p, 1e-4) / (1 + sum(greatest(0, 1e-4 - p)) OVER (PARTITION BY track_id, band)) AS p FROM hist)"
_PLAIN = f"{_RAW}, h AS (SELECT * FROM hist)"
_FORMULAS = {
    "kl": (True, "sum(a.p * log2(a.p / b.p))"),
    "jeffreys": (True, "sum((a.p - b.p) * log2(a.p / b.p))"),
    "expected_value": (False, "abs(sum(a.bin / 15e0 * a.p) - sum(a.bin / 15e0 * b.p))"),
    "expected_diff": (False, "sum(a.bin / 15e0 * abs(a.p - b.p))"),
    "k": (True, "sum(a.p * ln(2 * a.p / (a.p + b.p)))"),
    "hellinger": (False, "sqrt(greatest(0, 1 - sum(sqrt(a.p * b.p))))"),
    "euclidean": (False, "sqrt(sum((a.p - b.p) * (a.p - b.p)))"),
    "jensen": (True, "sum((a.p * ln(a.p) + b.p * ln(b.p)) / 2 - (a.p + b.p) / 2 * ln((a.p + b.p) / 2))"),
}


def _to_seeds(name: str, seeds: str) -> str:
    smoothed, formula = _FORMULAS[name]
    return f"""{_SMOOTHED if smoothed else _PLAIN},
by_band AS (SELECT a.track_id AS seed_id, b.track_id, a.band, {formula} AS d FROM h AS a JOIN h AS b ON a.band = b.band AND a.bin = b.bin WHERE a.track_id IN ({seeds}) GROUP BY ALL),
dist AS (SELECT seed_id, track_id, sum(d) AS dist FROM by_band GROUP BY ALL)"""


def distance(name: str, seeds: tuple[int, ...]) -> str:
    return f"WITH {_to_seeds(name, ', '.join(map(str, seeds)))} SELECT seed_id, track_id, round(dist, 6) + 0e0 AS dist FROM dist"


def _top(name: str, seeds: str, candidates: str, n: int) -> str:
    return f"""{_to_seeds(name, seeds)},
score AS (SELECT track_id, round(coalesce(1 / sum(CASE WHEN dist <> 0 THEN 1 / dist END), 0), 8) AS distance FROM dist WHERE {candidates} GROUP BY track_id),
best AS (SELECT max(track_id) AS track_id, distance FROM score GROUP BY distance ORDER BY distance LIMIT {n})"""


def similar(name: str, seeds: tuple[int, ...]) -> str:
    s = ", ".join(map(str, seeds))
    return f"WITH {_top(name, s, f'track_id NOT IN ({s})', 10)} SELECT row_number() OVER (ORDER BY distance) AS rank, track_id, round(distance, 6) AS distance FROM best"


def distance_list() -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(_FORMULAS))
    return f"SELECT * FROM (VALUES {rows}) AS t(id, name)"


def _pairs(name: str) -> str:
    formula = _FORMULAS[name][1]
    return f"""{_PLAIN}, by_band AS (SELECT a.track_id AS i, b.track_id AS j, a.band, {formula} AS d FROM h AS a JOIN h AS b ON a.band = b.band AND a.bin = b.bin AND a.track_id > b.track_id GROUP BY ALL),
pair AS (SELECT i, j, round(sum(d), 6) + 0e0 AS dist FROM by_band GROUP BY ALL)"""


PAIRS = f"WITH {_pairs('hellinger')} SELECT i, j, CAST(i * (i - 1) // 2 + j AS BIGINT) AS k, dist FROM pair"
PAIRS_SORTED = f"WITH {_pairs('euclidean')} SELECT * FROM pair ORDER BY dist, i, j"
MATRIX = f"WITH {_pairs('hellinger')} SELECT * FROM pair UNION ALL SELECT j, i, dist FROM pair UNION ALL SELECT vec_id, vec_id, 0e0 FROM embeddings"

def _all_pairs() -> str:
    return f"""{_PLAIN}, by_band AS (SELECT a.track_id AS a, b.track_id AS b, a.band, sqrt(greatest(0, 1 - sum(sqrt(a.p * b.p)))) AS d FROM h AS a JOIN h AS b ON a.band = b.band AND a.bin = b.bin GROUP BY ALL),
dist AS (SELECT a, b, sum(d) AS d FROM by_band GROUP BY ALL)"""


# Hop frames and spectra: window 16, step 8

_FRAMED = """pos AS (SELECT user_id AS track_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
frame AS (SELECT DISTINCT track_id, f AS frame_no FROM pos, range(0, 100000) AS r(f) WHERE f * 8 + 16 < n AND f = pos // 8),
framed AS (SELECT track_id, CAST(frame_no AS INTEGER) AS frame_no, pos - frame_no * 8 AS k, value FROM frame JOIN pos USING (track_id) WHERE pos >= frame_no * 8 AND pos < frame_no * 8 + 16)"""
_WEIGHTED = f"{_FRAMED}, win AS (SELECT track_id, frame_no, k, value * 0.5e0 * (1 - cos(2 * pi() * k / 15)) AS x FROM framed)"
_POWER = f"""{_WEIGHTED}, spec AS (SELECT track_id, frame_no, CAST(b AS INTEGER) AS bin, pow(sum(x * cos(2 * pi() * b * k / 16)), 2) + pow(sum(x * sin(2 * pi() * b * k / 16)), 2) AS power
FROM win, range(9) AS r(b) GROUP BY ALL)"""
FRAMING = f"WITH {_FRAMED} SELECT track_id, frame_no, count(*) AS n, round(sum(value), 6) AS total, round(sum(value * k), 6) AS moment FROM framed GROUP BY ALL"
HANN = f"WITH {_WEIGHTED} SELECT track_id, frame_no, round(sum(x), 6) AS weighted FROM win GROUP BY ALL"
DFT_POWER = f"WITH {_POWER} SELECT track_id, frame_no, bin, round(power, 3) + 0e0 AS power FROM spec"


def _edges(bands: int, scale: str = "mel") -> str:
    """(band, edge) by the closed form of each scale; steps in doubles, so an edge may differ where 32-bit steps cross an integer."""
    to, back = {
        "mel": ("1127 * ln(1 + f / 700)", "700 * (exp(s / 1127) - 1)"),
        "bark": ("26.81e0 / (1 + 1960 / f) - 0.53e0", "1960 / (26.81e0 / (s + 0.53e0) - 1)"),
        "semitone": ("12 * log2(f / 127.09e0)", "127.09e0 * pow(2, s / 12)"),
    }[scale]
    at = lambda f: "(" + to.replace("f", f) + ")" if scale != "mel" else f"(1127e0 * ln(1 + {f} / 700))"
    low, high = at("20e0"), at("20000e0")
    edge = "{lo} + ({hi} - {lo}) / {n} * (b + 1)".format(lo=low, hi=high, n=bands)
    last = {"mel": 20000, "bark": 19999, "semitone": 19999}[scale]
    return f"SELECT CAST(b AS INTEGER) AS band, CASE WHEN b = {bands - 1} THEN {last} ELSE CAST(floor({back}) AS INTEGER) END AS edge FROM (SELECT b, {edge} AS s FROM range({bands}) AS r(b))"


def band_edges(scale: str) -> str:
    return _edges(24, scale)


_POINTS = ", ".join(f"({f}, {c!r}e0)" for f, c in LOUDNESS)
_WEIGHT = f"""pt AS (SELECT f AS f1, c AS c1, lead(f) OVER (ORDER BY f) AS f2, lead(c) OVER (ORDER BY f) AS c2 FROM (VALUES {_POINTS}) AS t(f, c)),
weight AS (SELECT band, any_value(edge) AS edge, coalesce(min((edge - f1) * (c2 - c1) / (f2 - f1) + c1), 1) AS w FROM edge LEFT JOIN pt ON edge >= f1 AND edge <= f2 GROUP BY band)"""
WEIGHTS = f"WITH edge AS ({_edges(24)}), {_WEIGHT} SELECT band, round(w, 6) AS weight FROM weight"


def _bands(weighted: bool, rate: int, bands: int) -> str:
    # With so few wide bands no bin passes two edges, so a bin's band is the number of edges it has reached.
    w = "w" if weighted else "1"
    return f"""{_POWER}, edge AS ({_edges(bands)}), {_WEIGHT},
place AS (SELECT b AS bin, (SELECT count(*) FROM edge WHERE band < {bands - 1} AND edge <= b * {rate} / 16e0) AS reached FROM range(9) AS r(b)),
walk AS (SELECT bin, CAST(least(reached, {bands - 1}) AS INTEGER) AS band FROM place),
value AS (SELECT f.track_id, f.frame_no, weight.band, 8 * any_value({w}) * sqrt(coalesce(sum(power), 0)) / 16 AS value
FROM (SELECT DISTINCT track_id, frame_no FROM spec) AS f CROSS JOIN weight LEFT JOIN walk ON walk.band = weight.band AND walk.bin > 0 LEFT JOIN spec ON spec.track_id = f.track_id AND spec.frame_no = f.frame_no AND spec.bin = walk.bin GROUP BY ALL)"""


def band_power(weighted: bool, rate: int) -> str:
    return f"WITH {_bands(weighted, rate, 4)} SELECT track_id, frame_no, band, round(value, 4) AS value FROM value"


def cepstrum(rate: int) -> str:
    # Six bands: the first three edges lie below bin 1, which moves on one band only.
    body = _bands(True, rate, 6)
    head, tail = body.split("walk AS (", 1)
    rest = tail.split("),\nvalue AS", 1)[1]
    step = f"""walk AS (SELECT bin, CAST(list_reduce(list_transform(range(0, bin + 1), lambda i: CAST(i AS BIGINT)), lambda band, i: CASE WHEN band < 5 AND i * {rate} / 16e0 >= edges[band + 1] THEN band + 1 ELSE band END, CAST(0 AS BIGINT)) AS INTEGER) AS band
FROM place, (SELECT list(edge ORDER BY band) AS edges FROM edge)"""
    return f"""WITH {head}{step}),
value AS{rest},
logs AS (SELECT track_id, frame_no, band, CASE WHEN value <> 0 THEN ln(value) ELSE 0 END AS x FROM value)
SELECT track_id, frame_no, CAST(q AS INTEGER) AS q, round(8 * sqrt(pow(sum(x * cos(2 * pi() * q * band / 6)), 2) + pow(sum(x * sin(2 * pi() * q * band / 6)), 2)) / 6, 4) AS value FROM logs, range(4) AS r(q) GROUP BY track_id, frame_no, q"""


# Statistics

_DAYS = _days(0.0)
_SHARES = ", ".join(f"round(100e0 * count(*) FILTER (WHERE least(greatest(floor(v / 0.25e0), 0), 13) = {r}) / count(*), 6) AS pct_{r}" for r in range(14))
BAND_STATS = f"WITH {_DAYS} SELECT band, round(min(v), 6) AS low, round(greatest(max(v), 0), 6) AS high, {_SHARES} FROM cell GROUP BY band"
_SELF = f"{_DAYS}, pair AS (SELECT a.track_id, a.frame_no AS i, b.frame_no AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM cell AS a JOIN cell AS b ON a.track_id = b.track_id AND a.band = b.band GROUP BY ALL)"
_MEANS = f"{_SELF}, means AS (SELECT track_id, i, avg(dist) AS mean FROM pair GROUP BY ALL)"
_SMOOTH = f"""{_MEANS}, placed AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY i) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM means),
smooth AS (SELECT a.track_id, a.i, avg(b.mean) AS smooth FROM placed AS a JOIN placed AS b ON a.track_id = b.track_id AND b.k >= a.k AND b.k < a.k + greatest(1, a.n // 10) GROUP BY ALL)"""
SELFSIM = f"WITH {_SELF} SELECT track_id, i, j, round(dist, 6) AS dist FROM pair"
ROWMEAN = f"WITH {_MEANS} SELECT track_id, i, round(mean, 6) AS mean FROM means"
SMOOTH = f"WITH {_SMOOTH} SELECT track_id, i, round(smooth, 6) AS smooth FROM smooth"
DRAMA = f"WITH {_SMOOTH} SELECT track_id, round(list_sort(list(smooth))[count(*) // 2 + 1], 6) AS score FROM smooth GROUP BY track_id"
SELFSIM_HIST = f"WITH {_SELF} SELECT CAST(floor(least(greatest(round(dist, 6), 0), 1 - 1e0 / 128) * 128) AS INTEGER) AS bin, count(*) AS count FROM pair GROUP BY ALL"


def norm(by: str) -> str:
    return f"""WITH {_DAYS}, ends AS (SELECT *, min(v) OVER (PARTITION BY {by}) AS low, greatest(0, max(v) OVER (PARTITION BY {by})) AS high FROM cell)
SELECT track_id, frame_no, band, round(CASE WHEN high = low THEN v ELSE (v - low) / (high - low) END, 6) AS scaled FROM ends"""


NORM_ALL = f"""WITH {_DAYS}, ends AS (SELECT min(v) AS least, greatest(0, max(v)) AS most, count(*) AS n FROM cell),
t AS (SELECT least + (most - least) * s / 100 AS t, n FROM ends, range(101) AS r(s)),
c AS (SELECT t, any_value(n) AS n, count(*) FILTER (WHERE v > t) AS above, count(*) FILTER (WHERE v < t) AS under FROM t, cell GROUP BY t),
lim AS (SELECT max(t) FILTER (WHERE above > 0.95e0 * n) AS low, min(t) FILTER (WHERE under > 0.95e0 * n) AS high FROM c)
SELECT track_id, frame_no, band, round(coalesce(least(greatest((v - coalesce(low, 0)) / nullif(high - coalesce(low, 0), 0), 0), 1), 0), 6) AS scaled FROM cell, lim"""
RASTER = f"""WITH {_DAYS}, px AS (SELECT track_id, frame_no, band, CAST(floor(least(greatest(v, 0), 1) * 16777215) AS BIGINT) AS c FROM cell)
SELECT track_id, frame_no, band, c & 255 AS r, (c >> 8) & 255 AS g, (c >> 16) & 255 AS b FROM px"""
TRAJECTORY = f"""WITH {_days(150.0)} SELECT track_id, frame_no, round(max(v) FILTER (WHERE band = 0), 6) AS x, round(max(v) FILTER (WHERE band = 1), 6) AS y, round(max(v) FILTER (WHERE band = 2), 6) AS z
FROM cell WHERE band < 3 GROUP BY track_id, frame_no HAVING max(v) > 1e-5"""

# Signals


def tempo(compat: bool) -> str:
    less = "sum" if compat else "avg"
    power = "pow(re * im, 2)" if compat else "re * re + im * im"
    return f"""WITH {_DAYS}, placed AS (SELECT track_id, frame_no, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM (SELECT DISTINCT track_id, frame_no FROM cell)),
unit AS (SELECT track_id, band, i, n, coalesce((v - min(v) OVER w) / nullif(greatest(0, max(v) OVER w), 0), 0) AS u FROM cell JOIN placed USING (track_id, frame_no) WINDOW w AS (PARTITION BY track_id, band)),
x AS (SELECT *, u - {less}(u) OVER (PARTITION BY track_id, band) AS x FROM unit),
s AS (SELECT track_id, band, f, n, sum(x * cos(2 * pi() * f * i / n)) AS re, sum(x * sin(2 * pi() * f * i / n)) AS im FROM x, range(0, 10000) AS r(f) WHERE f <= n // 2 GROUP BY ALL)
SELECT track_id, f, round(f * 600e0 / n, 6) AS bpm, round(CASE WHEN f = 0 OR f * 600e0 / n < 5 THEN 0 ELSE sqrt(sum({power}) / n) END, 5) AS power FROM s GROUP BY track_id, f, n"""


_VEC = "vec AS (SELECT vec_id AS track_id, CAST(i - 1 AS INTEGER) AS k, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS t(i))"
HARMONIC = """SELECT vec_id AS track_id, CAST(k AS INTEGER) AS bin, round(abs(CAST(embedding[k + 1] AS DOUBLE)) * coalesce(abs(CAST(embedding[2 * k + 1] AS DOUBLE)), 0) * coalesce(abs(CAST(embedding[3 * k + 1] AS DOUBLE)), 0), 6) + 0e0 AS product
FROM embeddings, range(64) AS r(k)"""
NOTES = f"""WITH {_VEC}, top AS (SELECT track_id, k, abs(x) >= 0.75e0 * max(abs(x)) OVER (PARTITION BY track_id) AS b FROM vec)
SELECT track_id, CAST(floor(12 / ln(2) * (ln(k) + ln(8000 / (128 * 130.812e0)))) AS INTEGER) AS note, max(CAST(b AS INTEGER)) AS active FROM top WHERE k >= floor(130.812e0 * 128 / 8000) AND k >= 1 GROUP BY ALL"""
_D4 = "d4 AS (SELECT (1 + sqrt(3)) / (4 * sqrt(2)) AS a, (3 + sqrt(3)) / (4 * sqrt(2)) AS b, (3 - sqrt(3)) / (4 * sqrt(2)) AS c, (1 - sqrt(3)) / (4 * sqrt(2)) AS d)"
_FILTER = f"""{_D4}, tap AS (SELECT CAST(o AS INTEGER) AS o, CAST((2 * (o % 32) + t) % 64 AS INTEGER) AS k, CASE WHEN o < 32 THEN [a, b, c, d][t + 1] ELSE [d, -c, b, -a][t + 1] END AS w FROM d4, range(64) AS r(o), range(4) AS s(t))"""
DWT = f"WITH {_VEC}, {_FILTER} SELECT track_id, o AS k, round(sum(x * w), 6) + 0e0 AS x FROM vec JOIN tap USING (k) GROUP BY ALL"
DWT_INVERSE = f"WITH {_VEC}, {_FILTER} SELECT track_id, tap.k, round(sum(x * w), 6) + 0e0 AS x FROM vec JOIN tap ON vec.k = tap.o GROUP BY ALL"


def dwt_full(size: int) -> str:
    """All levels of the D4 transform, one table each: taps over the smooth part so far, whose details stand behind it."""
    parts, done, before = [f"WITH {_VEC}, {_D4}"], [], "vec"
    while size >= 4:
        half = size // 2
        parts.append(f"""t{size} AS (SELECT CAST(o AS INTEGER) AS o, CAST((2 * (o % {half}) + t) % {size} AS INTEGER) AS k, CASE WHEN o < {half} THEN [a, b, c, d][t + 1] ELSE [d, -c, b, -a][t + 1] END AS w FROM d4, range({size}) AS r(o), range(4) AS s(t)),
l{size} AS (SELECT track_id, o AS k, sum(x * w) AS x FROM {before} JOIN t{size} USING (k) GROUP BY ALL)""")
        done.append(f"SELECT * FROM l{size} WHERE k >= {half if size > 4 else 0}")
        before, size = f"(SELECT * FROM l{size} WHERE k < {half})", half
    return ", ".join(parts) + f" SELECT track_id, k, round(x, 5) + 0e0 AS x FROM ({' UNION ALL '.join(done)})"


DWT_ROUND_TRIP = f"WITH {_VEC} SELECT track_id, k, round(x, 5) + 0e0 AS x FROM vec"
GABOR = """WITH pos AS (SELECT user_id AS track_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
scale AS (SELECT CAST(k AS INTEGER) AS k, pow(2, -k / 12e0) AS den, sqrt(2 * ln(1e4)) * pow(2, -k / 12e0) * 400 AS reach FROM range(24, 12 * CAST(floor(log2(200 / 16.352e0)) AS BIGINT)) AS r(k)),
hop AS (SELECT DISTINCT track_id, pos AS u FROM pos WHERE pos % 16 = 0),
t AS (SELECT hop.track_id, k, u, den, (pos - u) / 400e0 / den AS t, value FROM hop JOIN pos USING (track_id), scale WHERE pos >= greatest(0, floor(u - reach)) AND pos < floor(u + reach))
SELECT track_id, k, u, round(sqrt(pow(sum(exp(-0.5e0 * t * t) / sqrt(den) * value * cos(2 * pi() * 16.352e0 * t)), 2) + pow(sum(exp(-0.5e0 * t * t) / sqrt(den) * value * sin(2 * pi() * 16.352e0 * t)), 2)), 4) AS power FROM t GROUP BY ALL"""

# Files

#: Two seconds more than the least of eight, all frames loud, each of 24 bands summing to 1.
INGEST = "SELECT s_suppkey AS track_id, CAST(10 AS INTEGER) AS length, CAST(ceil((10 * 44100 - 2048) / 1024e0) AS BIGINT) AS frames, CAST(24 AS INTEGER) AS bands, 24e0 AS mass FROM supplier"
_TONES = """tone AS (SELECT s_suppkey AS track_id, n AS pos, trunc(sum(sin(2 * pi() * 110 * pow(2, (s_suppkey % 36) / 12e0) * o * (n / 8000e0) + s_suppkey) / o) / 3 * 32000) / 32768 AS value FROM supplier, range(8000) AS r(n), range(1, 9) AS h(o) GROUP BY s_suppkey, n),
framed AS (SELECT track_id, CAST(f AS INTEGER) AS frame_no, pos - f * 8 AS k, value FROM tone, range(998) AS r(f) WHERE (f = pos // 8 OR f = pos // 8 - 1) AND pos < f * 8 + 16)"""
#: Tones of a second at 8 kHz through framing, DFT, bands and histogram, cell by cell.
INGEST_STREAM = f"""WITH {_bands(True, 8000, 4).replace(_FRAMED, _TONES)},
binned AS (SELECT track_id, CAST(band AS INTEGER) AS band, CAST(floor(least(greatest(value, 0), 1 - 1e0 / 16) * 16) AS INTEGER) AS bin FROM value)
SELECT track_id, CAST(1 AS INTEGER) AS length, CAST(998 AS BIGINT) AS frames, band, bin, round(count(*) / 998e0, 6) AS p FROM binned GROUP BY track_id, band, bin"""
#: The same tones, nine bands of a window of 16, products with the double and the triple band, notes of the bands over 3/4 of the largest.
NOTE_FRAMES = f"""WITH {_bands(True, 8000, 9).replace(_FRAMED, _TONES)},
product AS (SELECT a.track_id, a.frame_no, a.band, a.value * coalesce(b.value, 0) * coalesce(c.value, 0) AS p FROM value AS a
  LEFT JOIN value AS b ON b.track_id = a.track_id AND b.frame_no = a.frame_no AND b.band = 2 * a.band LEFT JOIN value AS c ON c.track_id = a.track_id AND c.frame_no = a.frame_no AND c.band = 3 * a.band),
top AS (SELECT track_id, frame_no, band, p >= 0.75e0 * max(p) OVER (PARTITION BY track_id, frame_no) AS b FROM product)
SELECT track_id, frame_no, CAST(floor(12 / ln(2) * (ln(band) + ln(8000 / (16 * 130.812e0)))) AS INTEGER) AS note FROM top WHERE band >= 1 AND b GROUP BY ALL"""
LEGACY = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings)
SELECT '/parts/' || p_partkey AS fname, p_name AS title, p_brand AS artist, p_type AS album, CAST(p_size AS INTEGER) AS track, CAST(p_size * 37 AS INTEGER) AS length,
  round(CAST(CAST(e[1] / list_sum(e[1:16]) AS FLOAT) AS DOUBLE), 5) AS first_cell, round(CAST(CAST(e[64] / list_sum(e[49:64]) AS FLOAT) AS DOUBLE), 5) AS last_cell, false AS exclude FROM part JOIN v ON vec_id = p_partkey"""
#: First samples of the chunks of the stand-ins' tones: 16-bit values of eight overtones at 44.1 kHz, ten seconds.
AUDIO_SOURCE = """SELECT s_suppkey AS track_id, CAST(c AS INTEGER) AS chunk_no, 44100 AS frate, CAST(least(16384, 441000 - c * 16384) AS INTEGER) AS n,
  round(trunc(sum(sin(2 * pi() * 110 * pow(2, (s_suppkey % 36) / 12e0) * k * (c * 16384 / 44100e0) + s_suppkey) / k) / 3 * 32000) / 32768, 6) + 0e0 AS first
FROM supplier, range(27) AS r(c), range(1, 9) AS o(k) GROUP BY s_suppkey, c"""


def raster_files(colored: bool, inverted: bool) -> str:
    """Whole files in hexadecimal digits: header, then a row of five bands for each day."""
    byte = lambda k: f"{255 if inverted else 0} {'-' if inverted else '+'} ((c >> {8 * k}) & 255)"
    cell = "printf('%02X%02X%02X', " + ", ".join(f"CAST({byte(k)} AS INTEGER)" for k in range(3)) + ")" if colored else f"printf('%02X', CAST({byte(0)} AS INTEGER))"
    return f"""WITH {_DAYS}, px AS (SELECT track_id, frame_no, band, CAST(floor(least(greatest(v, 0), 1) * {16777215 if colored else 255}) AS BIGINT) AS c FROM cell)
SELECT track_id, hex(encode('P{6 if colored else 5}' || chr(10) || '5 ' || CAST(count(*) // 5 AS BIGINT) || chr(10) || '255' || chr(10))) || string_agg({cell}, '' ORDER BY frame_no, band) AS content FROM px GROUP BY track_id"""


# Clusters


def _pick(k: int, chosen: list[str]) -> str:
    seeds = " UNION ALL ".join(f"SELECT track_id FROM {c}" for c in chosen)
    return f"""s{k} AS (SELECT a AS track_id FROM dist WHERE b IN ({seeds}) AND a NOT IN ({seeds}) GROUP BY a HAVING min(d) > 0 ORDER BY round(sum(1 / (d * d)), 9), a LIMIT 1)"""


KMEANS_SEED = f"""WITH {_all_pairs()}, s0 AS (SELECT min(vec_id) AS track_id FROM embeddings), {_pick(1, ["s0"])}, {_pick(2, ["s0", "s1"])}, {_pick(3, ["s0", "s1", "s2"])}
SELECT 0 AS cluster_id, track_id FROM s0 UNION ALL SELECT 1, track_id FROM s1 UNION ALL SELECT 2, track_id FROM s2 UNION ALL SELECT 3, track_id FROM s3"""
KMEANS_STEP = f"""WITH {_to_seeds("hellinger", "0, 1, 2, 3")}, own AS (SELECT track_id, arg_min(seed_id, (round(dist, 9), seed_id)) AS cluster_id FROM dist GROUP BY track_id)
SELECT cluster_id, CAST(band AS INTEGER) AS band, CAST(bin AS INTEGER) AS bin, round(pow(avg(sqrt(p)), 2), 6) AS p FROM h JOIN own USING (track_id) GROUP BY ALL"""

MERGED_MOMENTS = """SELECT CAST(l_linenumber AS BIGINT) AS line, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity, round(avg(l_extendedprice), 4) AS mean_price,
round(var_samp(l_quantity), 4) AS var_quantity, round(var_samp(l_extendedprice), 2) AS var_price FROM lineitem GROUP BY l_linenumber"""

_SEEDED = KMEANS_SEED.partition("\nSELECT 0 AS cluster_id")[0]


def kmeans_rounds(rounds: int) -> str:
    """Assignment to the seeds, then a centroid and an assignment each round. An empty cluster would keep its centre; here none becomes empty."""
    parts = [_SEEDED.rstrip() + ", c0 AS (SELECT cluster_id, band, bin, p FROM h JOIN (SELECT 0 AS cluster_id, track_id FROM s0 UNION ALL SELECT 1, track_id FROM s1 UNION ALL SELECT 2, track_id FROM s2 UNION ALL SELECT 3, track_id FROM s3) USING (track_id))"]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT track_id, cluster_id, sum(d) AS d FROM (SELECT h.track_id, c.cluster_id, h.band, sqrt(greatest(0, 1 - sum(sqrt(h.p * c.p)))) AS d FROM h JOIN c{r} AS c ON h.band = c.band AND h.bin = c.bin GROUP BY ALL) GROUP BY ALL),
a{r} AS (SELECT track_id, arg_min(cluster_id, (round(d, 9), cluster_id)) AS cluster_id FROM d{r} GROUP BY track_id),
c{r + 1} AS (SELECT cluster_id, band, bin, pow(avg(sqrt(p)), 2) AS p FROM h JOIN a{r} USING (track_id) GROUP BY ALL)""")
    return ",\n".join(parts) + f" SELECT track_id, cluster_id FROM a{rounds}"


# Texts

SIMILAR_REPORT = f"WITH {_top('hellinger', '3, 5, 8', 'track_id NOT IN (3, 5, 8)', 10)} SELECT rank, printf('%f', distance) || chr(9) || rpad(p_name, CAST(greatest(40, length(p_name)) AS INTEGER), ' ') || rpad(p_brand, CAST(greatest(30, length(p_brand)) AS INTEGER), ' ') || rpad(p_type, CAST(greatest(30, length(p_type)) AS INTEGER), ' ') AS line FROM (SELECT row_number() OVER (ORDER BY distance) AS rank, track_id, distance FROM best) JOIN part ON p_partkey = track_id"
MATRIX_PRINT = f"WITH {_pairs('hellinger').replace('round(sum(d), 6) + 0e0', 'sum(d)')} SELECT i, string_agg(printf('%.2f', dist), ' ' ORDER BY j) AS line FROM pair GROUP BY i"
SPECTRUM_TEXT = f"WITH {_DAYS} SELECT track_id, frame_no, string_agg(CAST(CAST(round(CAST(CAST(v AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DECIMAL(18, 4)) AS VARCHAR), ' ' ORDER BY band) AS line FROM cell GROUP BY ALL"
STATS_REPORT = f"SELECT band, printf('%.4f', low) || ' ' || printf('%.4f', high) || ' ' || " + " || ' ' || ".join(f"printf('%.2f', pct_{r})" for r in range(14)) + f" AS line FROM ({BAND_STATS})"

# Radio and streams

_FEEDBACK = """fb AS (SELECT user_id AS session, ts, event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'play' WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' ELSE 'next' END AS kind, CAST(floor(value) AS BIGINT) AS track_id FROM events)"""


def _radio(seeds: str, current: int) -> str:
    gone = f"track_id NOT IN (3, 5, 8, {current}) AND track_id NOT IN (SELECT x.p_partkey FROM part AS x JOIN part AS y ON lower(x.p_name) = lower(y.p_name) AND lower(x.p_brand) = lower(y.p_brand) WHERE y.p_partkey = {current})"
    return f"WITH {_top('hellinger', seeds, gone, 1)} SELECT track_id, round(distance, 6) AS distance FROM best"


_EVENTS = f"{_FEEDBACK}, e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS k FROM fb)"
_START = "SELECT DISTINCT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS likes, CAST([] AS BIGINT[]) AS recents, CAST([] AS BIGINT[]) AS excluded"


def _after(track: str) -> str:
    """The lists after an event of track, the oldest of more than four dropping out."""
    place = f"list_position(recents, {track})"
    gone = f"CASE WHEN list_contains(recents, {track}) THEN list_concat(recents[: {place} - 1], recents[{place} + 1 :]) ELSE recents END"
    return f"""CASE WHEN kind IN ('like', 'click') THEN list_append(likes, {track})[-4:] ELSE likes END AS likes,
CASE WHEN kind IN ('like', 'click', 'dislike') THEN {gone} WHEN kind = 'next' AND {track} IS NOT NULL THEN list_append(recents, {track})[-4:] ELSE recents END AS recents,
CASE WHEN kind IN ('play', 'click', 'next') AND {track} IS NOT NULL AND NOT list_contains(excluded, {track}) THEN list_append(excluded, {track}) ELSE excluded END AS excluded"""


RADIO_STATE = f"""WITH RECURSIVE {_EVENTS},
s AS ({_START} FROM e UNION ALL SELECT s.session, e.k, e.event_id, {_after("track_id")} FROM s JOIN e ON e.session = s.session AND e.k = s.k + 1)
SELECT session, event_id, coalesce(array_to_string(likes, ','), '') AS likes, coalesce(array_to_string(recents, ','), '') AS recents, CAST(len(excluded) AS BIGINT) AS n_excluded FROM s WHERE k > 0"""
RADIO_LOOP = f"""WITH RECURSIVE {_EVENTS.replace("e AS (", "e AS MATERIALIZED (")}, {_all_pairs().replace("dist AS (", "dist AS MATERIALIZED (")},
name AS MATERIALIZED (SELECT p_partkey AS track_id, lower(p_name) AS title, lower(p_brand) AS artist FROM part),
s AS ({_START}, CAST(NULL AS BIGINT) AS current, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS DOUBLE) AS distance FROM e
UNION ALL SELECT session, k, event_id, {_after("track")}, CASE WHEN kind IN ('play', 'click', 'next') THEN coalesce(track, current) ELSE current END, step + CASE WHEN kind = 'next' THEN 1 ELSE 0 END, CASE WHEN kind = 'next' THEN track END, dist
FROM (SELECT x.*, CASE WHEN kind = 'next' THEN found.track ELSE event_track END AS track, found.dist
  FROM (SELECT s.session, e.k, e.event_id, likes, recents, excluded, current, step, kind, e.track_id AS event_track, CASE WHEN len(likes) + len(recents) > 0 THEN list_concat(likes, recents) WHEN current IS NOT NULL THEN [current] ELSE [] END AS seeds FROM s JOIN e ON e.session = s.session AND e.k = s.k + 1) AS x
  LEFT JOIN (SELECT session, arg_min(b, (dist, -b)) AS track, min(dist) AS dist FROM (
    SELECT y.session, b, round(coalesce(1 / sum(CASE WHEN d <> 0 THEN 1 / d END), 0), 8) AS dist
    FROM (SELECT s.session, excluded, current, CASE WHEN len(likes) + len(recents) > 0 THEN list_concat(likes, recents) ELSE [current] END AS seeds, unnest(CASE WHEN len(likes) + len(recents) > 0 THEN list_concat(likes, recents) ELSE [current] END) AS seed
      FROM s JOIN e ON e.session = s.session AND e.k = s.k + 1 WHERE kind = 'next') AS y
    JOIN dist ON a = seed LEFT JOIN name AS own ON own.track_id = current LEFT JOIN name AS other ON other.track_id = b
    WHERE NOT list_contains(excluded, b) AND NOT list_contains(seeds, b) AND NOT coalesce(own.title = other.title AND own.artist = other.artist, false) GROUP BY y.session, b) GROUP BY session) AS found ON found.session = x.session AND kind = 'next'))
SELECT session, CAST(step - 1 AS INTEGER) AS step, pick AS track_id, round(distance, 6) AS distance FROM s WHERE pick IS NOT NULL"""
RADIO_NEXT, RADIO_RETRY = _radio("3, 5, 8", 8), _radio("5", 5)
RADIO_RECENT = f"""WITH {_FEEDBACK}, last AS (SELECT session, track_id, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS k FROM fb WHERE kind = 'next')
SELECT session, string_agg(track_id, ',' ORDER BY k DESC) AS tracks FROM last WHERE k <= 4 GROUP BY session"""
HISTORY = f"WITH {_FEEDBACK} SELECT session, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS seq, track_id FROM fb WHERE kind IN ('play', 'click', 'next')"
STREAM_FRAMING = f"WITH {_FRAMED} SELECT track_id, frame_no, round(sum(value), 6) AS total FROM framed GROUP BY ALL"
STREAM_WINDOW = """SELECT strftime(d - k * INTERVAL 1 DAY, '%Y-%m-%d') AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT CAST(ts AS DATE) AS d, event_type, value FROM events), range(2) AS r(k) GROUP BY ALL"""
#: Windows that the watermark, a day behind the latest event, has passed.
STREAM_WINDOW_CLOSED = f"SELECT * FROM ({STREAM_WINDOW}) WHERE CAST(start AS DATE) + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"
