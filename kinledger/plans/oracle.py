"""SQL fragments for the oracle, generated from the same tables as the Columns."""

from __future__ import annotations

from functools import reduce

from kinledger.functions import normalize as n


def _quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def single_blanks(e: str) -> str:
    return rf"regexp_replace({e}, '\s+', ' ', 'g')"


def swap(e: str, table: dict[str, str]) -> str:
    return reduce(lambda x, kv: rf"regexp_replace({x}, '\b{kv[0]}\b', '{kv[1]}', 'g')", table.items(), e)


def title(e: str) -> str:
    return f"array_to_string(list_transform(string_split({e}, ''), lambda ch, i: CASE WHEN i = 1 OR NOT regexp_matches(substr({e}, i - 1, 1), '[A-Za-z]') THEN upper(ch) ELSE lower(ch) END), '')"


def name(e: str) -> str:
    """Everything but the title case, which wants its input as a column."""
    x = reduce(lambda y, s: rf"regexp_replace({y}, '(?i)\b{s}\b[.,]?\s*$', '', 'g')", n.LEGAL_SUFFIXES, strip(f"coalesce({e}, '')"))
    x = strip(single_blanks(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"))
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: NOT (upper(w) IN ({_quoted(n.BUSINESS_TERMS)})) AND w <> ''), ' ')"


def address(e: str) -> str:
    x = swap(swap(f"upper({strip(f'coalesce({e}, {chr(39)}{chr(39)})')})", n.STREETS), n.STATES)
    x = single_blanks(f"regexp_replace({x}, '[.,#]', ' ', 'g')")
    return strip(swap(x, n.DIRECTIONS))


def state(e: str) -> str:
    up = f"upper({strip(e)})"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in n.STATES.items())
    return f"CASE WHEN {up} IN ({_quoted(n.STATES.values())}) THEN {up} ELSE coalesce(CASE {up} {cases} END, {e}) END"


def soundex(e: str) -> str:
    """For text that begins with a letter; other characters part equal codes, H and W don't."""
    codes = lambda x: f"translate({x}, 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556')"
    first, rest = f"upper(substr({e}, 1, 1))", f"regexp_replace(regexp_replace(upper(substr({e}, 2)), '[^A-Z]', '0', 'g'), '[HW]', '', 'g')"
    every = f"concat({codes(f'translate({first}, {chr(39)}HW{chr(39)}, {chr(39)}00{chr(39)})')}, {codes(rest)})"
    once = reduce(lambda x, d: f"regexp_replace({x}, '{d}+', '{d}', 'g')", "123456", every)
    return f"concat({first}, substr(concat(replace(substr({once}, 2), '0', ''), '000'), 1, 3))"


def in_list(e: str, items) -> str:
    return f"coalesce({e} IN ({_quoted(items)}), false)"


def confidence(pct: str, length: str) -> str:
    return (
        f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (CASE WHEN {length} > 3 THEN pow(CAST(0.9 AS DOUBLE), {length} - 3) ELSE CAST(1 AS DOUBLE) END)"
        f" * (CASE WHEN {pct} < 50 THEN {pct} / 50.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN {pct} < 25 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)))"
    )


def walk(types: tuple[str, ...], depth: int, incoming: bool = True, least: float | None = None, both: bool = False, start: str | None = None) -> str:
    """Recursive trails over ``relationships`` as table expression ``walk``."""
    near, far = ("target_entity_id", "source_entity_id") if incoming else ("source_entity_id", "target_entity_id")
    where = f"WHERE relationship_type IN ({_quoted(types)})" if types else ""
    hop = f"SELECT {near} AS near, {far} AS far, relationship_id AS edge, coalesce(ownership_pct, CAST(100 AS DOUBLE)) AS share FROM relationships {where}"
    if both:
        hop += f" UNION ALL SELECT {far}, {near}, relationship_id, coalesce(ownership_pct, CAST(100 AS DOUBLE)) FROM relationships {where or 'WHERE true'} AND {near} <> {far}"
    cut = f"AND w.pct * h.share / CAST(100 AS DOUBLE) >= {least}" if least is not None else ""
    first = [f"near = '{start}'"] * (start is not None) + [f"CAST(100 AS DOUBLE) * share / CAST(100 AS DOUBLE) >= {least}"] * (least is not None)
    return f"""hop AS ({hop}),
        walk(start_id, node, pct, edges, nodes, hops) AS (
            SELECT near, far, CAST(100 AS DOUBLE) * share / CAST(100 AS DOUBLE), [edge], [near, far], 1 FROM hop {'WHERE ' + ' AND '.join(first) if first else ''}
            UNION ALL
            SELECT w.start_id, h.far, w.pct * h.share / CAST(100 AS DOUBLE), list_append(w.edges, h.edge), list_append(w.nodes, h.far), w.hops + 1
            FROM walk w JOIN hop h ON h.near = w.node WHERE w.hops < {depth} AND NOT list_contains(w.edges, h.edge) {cut})"""


def ubo(depth: int = 10, least: float = 25.0, limit: int = 50) -> str:
    """Table expressions up to ``ubos``."""
    from kinledger.operators.ownership import UBO_TYPES

    return f"""{walk(UBO_TYPES, depth, least=least)},
        owned AS (SELECT DISTINCT w.start_id, e.entity_id AS owner_id, e.name AS owner_name, e.entity_type AS owner_type, w.pct AS effective_pct,
                array_to_string(w.nodes, '>') AS path, array_to_string(w.edges, '>') AS edge_path, w.hops AS chain_length
            FROM walk w JOIN entities e ON e.entity_id = w.node WHERE e.entity_type IN ('INDIVIDUAL', 'GOVERNMENT') AND w.pct >= {least}),
        ubos AS (SELECT *, {confidence('effective_pct', 'chain_length')} AS confidence FROM (
            SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY effective_pct DESC, owner_id, edge_path) AS rn FROM owned) WHERE rn <= {limit})"""


def cycles(depth: int = 10, limit: int = 10) -> str:
    from kinledger.operators.ownership import CYCLE_TYPES

    return f"""{walk(CYCLE_TYPES, depth, incoming=False)},
        cycles AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY cycle_length, edge_path) AS rn FROM (
            SELECT start_id, array_to_string(nodes, '>') AS path, array_to_string(edges, '>') AS edge_path, hops AS cycle_length FROM walk WHERE node = start_id AND hops > 1)) WHERE rn <= {limit})"""


NOMINEES = """
    ties AS (SELECT DISTINCT r.source_entity_id AS person_id, e.name AS person_name, r.target_entity_id AS target FROM relationships r
        JOIN entities e ON e.entity_id = r.source_entity_id WHERE e.entity_type = 'INDIVIDUAL' AND r.relationship_type IN ('DIRECTOR_OF', 'SHAREHOLDER_OF')),
    many AS (SELECT t.person_id, t.person_name, count(DISTINCT t.target) AS entity_count, list_sort(list(DISTINCT e.name)) AS entities_involved
        FROM ties t JOIN entities e ON e.entity_id = t.target GROUP BY ALL HAVING count(DISTINCT t.target) >= 5),
    nominees AS (SELECT t.target AS start_id, m.*, CASE WHEN entity_count > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
        concat('Individual is director/shareholder of ', CAST(entity_count AS VARCHAR), ' entities') AS rationale FROM ties t JOIN many m ON m.person_id = t.person_id)"""
