"""The same results in DuckDB SQL: pieces that the oracle queries are made of."""

from __future__ import annotations

from ..functions.layout import LAYOUTS, neighbours

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

TERMS = f"""words AS (SELECT unnest(regexp_extract_all(translate(text, {AZ}), '[a-z]+')) AS term FROM benchmark),
counts AS (SELECT term, count(*) AS c FROM words GROUP BY term),
items AS (SELECT row_number() OVER (ORDER BY c DESC, term) - 1 AS input_index, term, least(c, 65535) AS weight FROM counts),
dict AS (SELECT row_number() OVER (ORDER BY term) - 1 AS id, term AS norm, weight, input_index, length(term) AS n FROM items)"""

#: One typo of each term, its kind by the term's length; see plans.catalog.
KIND = "CASE length(norm) % 6 WHEN 0 THEN 'drop' WHEN 1 THEN 'swap' WHEN 2 THEN 'double' WHEN 3 THEN 'neighbour' WHEN 4 THEN 'first' ELSE 'insert' END"
_MADE = """CASE kind WHEN 'drop' THEN substr(norm, 1, 2) || substr(norm, 4)
 WHEN 'swap' THEN substr(norm, 1, 2) || substr(norm, 4, 1) || substr(norm, 3, 1) || substr(norm, 5)
 WHEN 'double' THEN substr(norm, 1, 2) || substr(norm, 2)
 WHEN 'neighbour' THEN substr(norm, 1, 1) || translate(substr(norm, 2, 1), 'qwertyuiopasdfghjklzxcvbnm', 'wertyuiopqsdfghjklaxcvbnmz') || substr(norm, 3)
 WHEN 'first' THEN translate(substr(norm, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') || substr(norm, 2)
 ELSE substr(norm, 1, 2) || 'e' || substr(norm, 3) END"""
TYPOS = f"""kinds AS (SELECT id AS qid, norm, {KIND} AS kind FROM dict),
typos AS (SELECT qid, {_MADE} AS typo, norm AS correct, kind FROM kinds),
pairs AS (SELECT * FROM typos WHERE typo <> correct AND typo NOT IN (SELECT norm FROM dict)),
queries AS (SELECT qid, typo AS q FROM pairs)"""


def costs(unit: bool = False, layout: str = "qwerty") -> str:
    """The cell c = (i, j) of a matrix that is appended to a list d."""
    near = " " + " ".join(sorted(a + b for a, b in neighbours(layout) if (a + b).isalpha())) + " "
    sub, near_sub, indel, twin, swap = (1, 1, 1, 1, 1) if unit else (16, 8, 16, 8, 12)
    first = (lambda cost, at: str(cost)) if unit else (lambda cost, at: f"(CASE WHEN {at} = 0 THEN ({cost}) * 3 // 2 ELSE {cost} END)")
    s = f"CASE WHEN substr(q, i, 1) = substr(t, j, 1) THEN 0 ELSE {first(f'(CASE WHEN contains({near!r}, substr(q, i, 1) || substr(t, j, 1)) THEN {near_sub} ELSE {sub} END)', 'i - 1')} END"
    lose = first(f"(CASE WHEN i > 1 AND substr(q, i, 1) = substr(q, i - 1, 1) THEN {twin} ELSE {indel} END)", "i - 1")
    gain = first(f"(CASE WHEN j > 1 AND substr(t, j, 1) = substr(t, j - 1, 1) THEN {twin} ELSE {indel} END)", "i")
    swapped = "i > 1 AND j > 1 AND substr(q, i, 1) = substr(t, j - 1, 1) AND substr(q, i - 1, 1) = substr(t, j, 1) AND substr(q, i, 1) <> substr(q, i - 1, 1)"
    return f"""least(CASE WHEN i > 0 AND j > 0 THEN d[c - m - 1] + {s} ELSE 30000 END, CASE WHEN i > 0 THEN d[c] + {lose} ELSE 30000 END,
 CASE WHEN j > 0 THEN d[c - m] + {gain} ELSE 30000 END, CASE WHEN {swapped} THEN d[c - 2 * m - 3] + {first(str(swap), 'i - 2')} ELSE 30000 END)"""


def matrices(pairs: str, unit: bool = False, layout: str = "qwerty", last: str = "d[-1]") -> str:
    """CTEs: scored(q, t, cost) of the distinct (q, t) of `pairs`."""
    return f"""dp AS (SELECT q, t, length(q) AS m, length(t) AS n, 0 AS x, [0] AS d FROM (SELECT DISTINCT q, t FROM {pairs})
 UNION ALL SELECT q, t, m, n, c, list_append(d, ({costs(unit, layout)})::INT) FROM (SELECT *, x + 1 AS c, (x + 1) % (m + 1) AS i, (x + 1) // (m + 1) AS j FROM dp WHERE x + 1 < (m + 1) * (n + 1))),
scored AS (SELECT q, t, {last} AS cost FROM dp WHERE x + 1 = (m + 1) * (n + 1))"""


def _lacks(a: str, b: str) -> str:
    return f"len(list_filter(list_distinct(string_split({a}, '')), lambda s: NOT contains({b}, s))) * 8"


def search(budget: int = 32, ranking: str = "coarse", layout: str = "qwerty", prefix: bool = False, k: int = 10, queries: str = "queries", extra: str = "") -> str:
    """WITH ... up to hits(qid, q, rank, id, norm, cost, weight, input_index)."""
    band = budget // 8
    length = f"length(norm) >= length(q) - {band}" + ("" if prefix else f" AND length(norm) <= length(q) + {band}")
    term = f"substr(norm, 1, length(q) + {band})" if prefix else "norm"
    bound = f"{_lacks('q', 'norm')} <= {budget}" + ("" if prefix else f" AND {_lacks('norm', 'q')} <= {budget}")
    last = "list_min(list_transform(range(0, n + 1), lambda j: d[(j + 1) * (m + 1)]))" if prefix else "d[-1]"
    key = "(cost + 15) // 16" if ranking == "coarse" else "cost"
    return f"""WITH RECURSIVE {TERMS}, {TYPOS}{extra}, near AS (SELECT q, id, norm, weight, input_index, {term} AS t FROM (SELECT DISTINCT q FROM {queries}), dict WHERE {length} AND {bound}),
{matrices('near', layout=layout, last=last)},
best AS (SELECT q, id, norm, cost, weight, input_index, row_number() OVER (PARTITION BY q ORDER BY {key}, weight DESC, id) AS rank FROM near JOIN scored USING (q, t) WHERE cost <= {budget}),
hits AS (SELECT qid, q, rank, id, norm, cost, weight, input_index FROM {queries} JOIN best USING (q) WHERE rank <= {k})"""


NEIGHBOURS = "WITH rows(layout, row, keys) AS (VALUES " + ", ".join("('" + n + f"', {r}, '" + keys.replace("'", "''") + "')" for n, rows in LAYOUTS.items() for r, keys in enumerate(rows)) + """),
keys AS (SELECT layout, row, unnest(range(1, length(keys) + 1)) AS p, keys FROM rows), spots AS (SELECT layout, row, row + 2 * (p - 1) AS x, substr(keys, p, 1) AS k FROM keys)
SELECT a.layout, a.k AS a, b.k AS b FROM spots a JOIN spots b ON a.layout = b.layout AND (a.row = b.row AND abs(a.x - b.x) = 2 OR abs(a.row - b.row) = 1 AND abs(a.x - b.x) <= 1)"""


def soundex(w: str) -> str:
    """Letter and three digits of a word of small letters."""
    digits = lambda s: f"translate(translate({s}, 'hw', ''), 'abcdefgijklmnopqrstuvxyz', '012301202245501262301202')"
    c = f"(CASE WHEN substr({w}, 1, 1) IN ('h', 'w') THEN '0' ELSE '' END || {digits(w)})"
    for n in range(7):
        c = f"regexp_replace({c}, '{n}+', '{n}', 'g')"
    return f"upper(substr({w}, 1, 1)) || substr(replace(substr({c}, 2), '0', '') || '000', 1, 3)"
