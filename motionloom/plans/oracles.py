"""SQL of queries whose operator is a kernel: filters as recursions, spectra as sums, searches as joins."""

from __future__ import annotations

from motionloom.functions import signal


def lag_sums(v_cte: str, order: int) -> str:
    """Partial autocorrelations up to ``order`` by the Levinson recursion, one nested query an order."""
    r = ", ".join(f"sum(c * lead{k}) / (64 - {k}) AS r{k}" if k else "sum(c * c) / 64 AS r0" for k in range(order + 1))
    leads = ", ".join(f"lead(c, {k}) OVER (PARTITION BY key ORDER BY seq) AS lead{k}" for k in range(1, order + 1))
    sql, rs = "a", ", ".join(f"r{k}" for k in range(order + 1))
    for m in range(1, order + 1):
        top = " - ".join([f"r{m}", *(f"p{m - 1}_{j} * r{m - j}" for j in range(1, m))])
        error = f"e{m - 1}" if m > 1 else "r0"
        done = ", ".join(f"k{j}" for j in range(1, m)) + (", " if m > 1 else "")
        before = ", ".join(f"p{m - 1}_{j}" for j in range(1, m)) + (", " if m > 1 else "")
        inner = f"(SELECT key, {rs}, {done}{before}{error}, ({top}) / {error} AS k{m} FROM {sql})"
        after = ", ".join([*(f"p{m - 1}_{j} - k{m} * p{m - 1}_{m - j} AS p{m}_{j}" for j in range(1, m)), f"k{m} AS p{m}_{m}"])
        sql = f"(SELECT key, {rs}, {done}k{m}, {after}, {error} * (1 - k{m} * k{m}) AS e{m} FROM {inner})"
    return f"""WITH {v_cte}, m AS (SELECT key, seq, v - avg(v) OVER (PARTITION BY key) AS c FROM v), l AS (SELECT key, seq, c, {leads} FROM m),
a AS (SELECT key, {r} FROM l GROUP BY key) SELECT key, {", ".join(f"round(k{m}, 6) + 0.0 AS lag{m}" for m in (3, 5, 6))} FROM {sql}"""


def recursion(source: str, b, a, name: str = "filtered") -> str:
    """CTEs ``h`` and ``name`` (key, seq, y): the recursive filter b, a over ``source`` (key, seq from 0, v)."""
    n = len(a)
    xs = ", ".join(f"coalesce(lag(v, {k}) OVER w, 0) AS x{k}" for k in range(1, n))
    gain = " + ".join(f"({b[k] / a[0]!r}) * {'v' if not k else f'x{k}'}" for k in range(n))
    back = " + ".join(f"({-a[k] / a[0]!r}) * f.y{k - 1 if k > 1 else ''}" for k in range(1, n))
    moved = "".join(f", f.y{k - 2 if k > 2 else ''} AS y{k - 1}" for k in range(2, n))
    zero = "".join(f", 0.0::DOUBLE AS y{k}" for k in range(1, n - 1))
    return f"""h AS MATERIALIZED (SELECT key, seq, {gain} AS u FROM (SELECT key, seq, v, {xs} FROM {source} WINDOW w AS (PARTITION BY key ORDER BY seq))),
{name} AS (SELECT key, seq, u AS y{zero} FROM h WHERE seq = 0 UNION ALL SELECT f.key, h.seq, h.u + {back} AS y{moved} FROM {name} f JOIN h ON h.key = f.key AND h.seq = f.seq + 1)"""


def filtered(v_cte: str, kind: str) -> str:
    b, a = signal.butterworth(*((2, 0.04, "high") if kind == "high" else (4, 0.2, "low")))
    return f"WITH RECURSIVE {v_cte}, {recursion('v', b.tolist(), a.tolist())} SELECT key, seq, round(y, 6) + 0.0 AS filtered FROM filtered"


def welch_power(source: str, seg: int, fs: float, length: str = "64") -> str:
    """CTEs ending in ``p`` (key, n, k, p): mean power of half-overlapping segments of at most ``seg`` samples of ``source`` (key, seq, v)."""
    return f"""n AS (SELECT key, least({seg}, max(seq) + 1) AS n, max(seq) + 1 AS total FROM {source} GROUP BY key),
g AS (SELECT key, n, unnest(range(0, total - n + 1, greatest(n - n // 2, 1))) AS s FROM n),
c AS (SELECT g.key, g.n, g.s, t.seq - g.s AS i, t.v - avg(t.v) OVER (PARTITION BY g.key, g.s) AS v FROM g JOIN {source} t ON t.key = g.key AND t.seq >= g.s AND t.seq < g.s + g.n),
wd AS MATERIALIZED (SELECT key, n, s, i, v * (0.5 - 0.5 * cos(2 * pi() * i / n)) AS v, pow(0.5 - 0.5 * cos(2 * pi() * i / n), 2) AS w FROM c),
k AS (SELECT DISTINCT n, unnest(range(0, n // 2 + 1)) AS k FROM n),
q AS (SELECT key, wd.n, s, k, (pow(sum(v * cos(2 * pi() * ((k * i) % wd.n) / wd.n)), 2) + pow(sum(v * sin(2 * pi() * ((k * i) % wd.n) / wd.n)), 2)) / ({fs} * sum(w)) AS p FROM wd JOIN k ON wd.n = k.n GROUP BY key, wd.n, s, k),
p AS (SELECT key, n, k, avg(p) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p FROM q GROUP BY key, n, k)"""


def tremor(bins: str, low: float, high: float, centre: bool) -> str:
    """Spectral amplitudes of high-passed bins; ``bins`` are CTEs ending in ``j`` (key, seq, v)."""
    b, a = signal.butterworth(2, 0.04, "high")
    source = "m" if centre else "j"
    mean = "m AS MATERIALIZED (SELECT key, seq, v - avg(v) OVER (PARTITION BY key) AS v FROM j), " if centre else ""
    return f"""WITH RECURSIVE {bins}, {mean}{recursion(source, b.tolist(), a.tolist(), 'fl')},
y AS MATERIALIZED (SELECT key, seq, y AS v FROM fl), {welch_power('y', 256, 100.0)},
z AS (SELECT key, greatest(total // 2 - 128, 0) AS start, total, least(256, total - greatest(total // 2 - 128, 0)) AS size FROM n),
x AS MATERIALIZED (SELECT y.key, z.size, z.total, y.seq - z.start AS i, v * (0.5 - 0.5 * cos(2 * pi() * (y.seq - z.start) / greatest(size - 1, 1))) AS v FROM y JOIN z ON y.key = z.key AND y.seq >= z.start AND y.seq < z.start + z.size),
kk AS (SELECT DISTINCT size, unnest(range(0, size // 2)) AS k FROM z),
ft AS (SELECT key, k, k * 100.0 / x.size AS f, sqrt(pow(sum(v * cos(2 * pi() * ((k * i) % x.size) / x.size)), 2) + pow(sum(v * sin(2 * pi() * ((k * i) % x.size) / x.size)), 2)) / greatest(least(256, max(total)), 1) AS m FROM x JOIN kk ON x.size = kk.size GROUP BY key, k, x.size),
fa AS (SELECT key, sum(m) AS a, max_by(f, m) AS f FROM ft WHERE f > {low} AND f < {high} GROUP BY key),
wa AS (SELECT key, coalesce(sum(p) FILTER (WHERE k * 100.0 / n > {low} AND k * 100.0 / n < {high}), 0) AS a, max_by(k * 100.0 / n, p) AS f FROM p GROUP BY key)
SELECT wa.key, round(coalesce(fa.a, 0), 6) + 0.0 AS fft_amplitude, round(fa.f, 6) + 0.0 AS fft_frequency, round(wa.a, 6) + 0.0 AS welch_amplitude, round(wa.f, 6) + 0.0 AS welch_frequency FROM wa LEFT JOIN fa ON wa.key = fa.key"""


def peaks_cte() -> str:
    """CTEs ``pk`` (key, seq, v: strict local maxima of v) and ``pr`` (key, seq, prominence)."""
    return """pk AS MATERIALIZED (SELECT key, seq, v FROM (SELECT key, seq, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM v WINDOW w AS (PARTITION BY key ORDER BY seq)) WHERE v > a AND v > b),
lr AS (SELECT pk.key, pk.seq, pk.v, coalesce(max(v.seq) FILTER (WHERE v.seq < pk.seq AND v.v > pk.v), -1) AS l, coalesce(min(v.seq) FILTER (WHERE v.seq > pk.seq AND v.v > pk.v), 1000000) AS r FROM pk JOIN v ON v.key = pk.key GROUP BY pk.key, pk.seq, pk.v),
pr AS MATERIALIZED (SELECT lr.key, lr.seq, lr.v - greatest(min(v.v) FILTER (WHERE v.seq > l AND v.seq <= lr.seq), min(v.v) FILTER (WHERE v.seq >= lr.seq AND v.seq < r)) AS prominence FROM lr JOIN v ON v.key = lr.key GROUP BY lr.key, lr.seq, lr.v, l, r)"""


def peakdet(source: str, delta: float, name: str = "pd") -> str:
    """CTE ``name`` (needs RECURSIVE): walk over ``source`` (key, seq from 0, v); ``top`` and ``dip`` are positions found at a step, -1 if none."""
    return f"""{name} AS (SELECT key, -1::BIGINT AS seq, true AS seek, -1e300::DOUBLE AS high, -1::BIGINT AS at_high, 1e300::DOUBLE AS low, -1::BIGINT AS at_low, -1::BIGINT AS top, -1::BIGINT AS dip FROM (SELECT DISTINCT key FROM {source})
  UNION ALL SELECT key, seq, CASE WHEN top >= 0 THEN false WHEN dip >= 0 THEN true ELSE seek END, CASE WHEN dip >= 0 THEN v ELSE high END, CASE WHEN dip >= 0 THEN seq ELSE at_high END, CASE WHEN top >= 0 THEN v ELSE low END, CASE WHEN top >= 0 THEN seq ELSE at_low END, top, dip
  FROM (SELECT *, CASE WHEN seek AND v < high - {delta} THEN at_high ELSE -1 END AS top, CASE WHEN NOT seek AND v > low + {delta} THEN at_low ELSE -1 END AS dip
    FROM (SELECT f.key, s.seq, s.v, seek, greatest(high, s.v) AS high, CASE WHEN s.v > high THEN s.seq ELSE at_high END AS at_high, least(low, s.v) AS low, CASE WHEN s.v < low THEN s.seq ELSE at_low END AS at_low FROM {name} f JOIN {source} s ON s.key = f.key AND s.seq = f.seq + 1)))"""


def joined(parts: dict[str, tuple[str, dict[str, str]]], constants: dict[str, str]) -> str:
    """One row a key out of whole queries with a column ``key``: alias to (SQL, {its column: name in the result})."""
    columns = [f"{a}.{c} AS {n}" for a, (_, names) in parts.items() for c, n in names.items()] + [f"{v} AS {n}" for n, v in constants.items()]
    first, *others = parts
    return f"SELECT {first}.key, {', '.join(columns)} FROM ({parts[first][0]}) {first} " + " ".join(f"LEFT JOIN ({parts[a][0]}) {a} ON {a}.key = {first}.key" for a in others)
