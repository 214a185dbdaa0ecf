"""DuckDB building blocks: common table expressions that restate each step in SQL."""

from __future__ import annotations

from ionloom.operators.instruments import LEVELS, RESOLUTIONS
from ionloom.plans import fixture as fx
from ionloom.sources.lookups import DEFAULT_INSTRUMENTS, default_adducts

H_MASS = "1.0078250322::DOUBLE"


def peak_text(peaks: str = "peaks", sep: str = ";") -> str:
    return f"array_to_string(list_transform({peaks}, lambda p: printf('%.8f %.8f', p.mz, p.intensity)), '{sep}')"


def number_text(col: str) -> str:
    return f"regexp_replace(printf('%.8f', {col}), '\\.?0+$', '')"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def _peaks_cte(name: str, mz: str, intensity: str) -> str:
    return (
        f"{name} AS (SELECT l_orderkey AS pk_id, list({{'mz': {mz}, 'intensity': {intensity}}} "
        f"ORDER BY {intensity} DESC, {mz}) AS peaks FROM lineitem GROUP BY 1)"
    )


def raw(name: str = "raw") -> list[str]:
    cols = ", ".join(f"{e} AS {c}" for c, e in fx.HEADER.items())
    return [
        _peaks_cte("pk", fx.MZ, fx.INTENSITY),
        f"{name} AS (SELECT {cols}, coalesce(pk.peaks, []) AS peaks FROM orders "
        "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN pk ON pk.pk_id = o_orderkey)",
    ]


def copies(name: str = "cp") -> list[str]:
    return raw("base") + [
        f"{name} AS (SELECT * FROM base UNION ALL SELECT * REPLACE (record_id + 1000000000 AS record_id, "
        "concat(comment, repeat('x', (record_id % 13)::INT)) AS comment) FROM base WHERE record_id % 7 = 0)"
    ]


def compounds(name: str = "compounds") -> str:
    cols = ", ".join(f"{e.replace('{0}', 'c_custkey')} AS {c}" for c, e in fx.COMPOUND_EXPRS.items())
    return f"{name} AS (SELECT {cols} FROM customer)"


def ontologies(name: str = "ontologies") -> str:
    cols = ", ".join(f"{e.replace('{0}', 'c_custkey')} AS {c}" for c, e in fx.ONTOLOGY_EXPRS.items())
    return (
        f"{name} AS (SELECT {cols} FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 5 <> 0)"
    )


def query(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(dict.fromkeys(ctes)) + "\n" + final


# --- metadata -------------------------------------------------------------------------------

EMPTY = r"(?i)(CCS:|\$:00in-source|0|0\.0|na|n/a|nan|unknown|unknow|none|\?|unk|x)( .*)?"
SMI = r"(?i)[^J][a-z0-9@+\-\[\]\(\)\\/%=#$]{6,}"
INC = r"(?i)InChI=.*|/[0-9A-Z]*/"
KEY = r"(?i)([A-Z]{14}-[A-Z]{10}-[NO])|([A-Z]{14})"
SILICO = r"(?i)in.silico|insilico|predicted|theoretical|Annotation.level.3"
TEXTS = [c for c in fx.HEADER if c not in ("record_id", "source")]


def empty(col: str) -> str:
    return f"CASE WHEN {col} = '' OR regexp_full_match({col}, '{EMPTY}') THEN NULL ELSE {col} END"


def empties(src: str, name: str = "emp") -> str:
    return f"{name} AS (SELECT * REPLACE ({', '.join(f'{empty(c)} AS {c}' for c in TEXTS)}) FROM {src})"


def has(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, '{pattern}'), false)"


def repair(src: str, name: str = "rep") -> str:
    def only(c: str) -> str:
        return f"({has(c, SMI)} AND NOT {has(c, INC)} AND NOT {has(c, KEY)})"

    tidy = f"({has('smiles', SMI)} AND {has('inchi', INC)} AND {has('inchikey', KEY)})"
    s = (
        f"CASE WHEN {tidy} THEN smiles WHEN {has('smiles', KEY)} OR {has('smiles', INC)} THEN NULL "
        f"WHEN {only('inchikey')} THEN inchikey WHEN {only('inchi')} THEN inchi ELSE smiles END"
    )
    i = (
        f"CASE WHEN {tidy} THEN inchi WHEN {has('inchi', KEY)} THEN NULL WHEN {has('inchikey', INC)} THEN inchikey "
        f"WHEN {has('smiles', INC)} THEN smiles WHEN {only('inchi')} THEN NULL ELSE inchi END"
    )
    k = (
        f"CASE WHEN {tidy} THEN inchikey WHEN {has('smiles', KEY)} THEN smiles WHEN {has('inchi', KEY)} THEN inchi "
        f"WHEN {has('inchikey', INC)} OR {only('inchikey')} THEN NULL ELSE inchikey END"
    )
    inchi = f"'InChI=' || regexp_replace(nullif({i}, ''), '(?i)^inchi=', '')"
    return (
        f"{name} AS (SELECT * REPLACE (nullif({s}, '') AS smiles, {inchi} AS inchi, nullif({k}, '') AS inchikey) "
        f"FROM {src})"
    )


def ionization_expr() -> str:
    def word(c: str) -> str:
        return f"replace(nullif(upper(regexp_extract({c}, '(?i)(APCI|ACPI|APPI|EI|ESI|FAB|MALDI)', 1)), ''), 'ACPI', 'APCI')"

    return f"coalesce({word('ionization')}, {word('instrumenttype')}, ionization)"


def instrument_text_expr() -> str:
    def part(col: str, split: bool) -> str:
        t = f"replace(replace(lower(coalesce({col}, '')), '-tof', 'tof'), 'q-', 'q')"
        t = f"replace({t}, '-', ' ')" if split else t
        for a, b in (("q exactive", " qexactive "), ("applied biosystems", " sciex "), (" ab ", " sciex "), ("sciex", " sciex ")):
            t = f"replace({t}, '{a}', '{b}')"
        for a, b in (("triple(-| )?tof", " qqq "), ("triple(-| )?quad", " qqq "), ("... uplc ...", " ")):
            t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
        return t

    joined = f"concat_ws(' ', {part('instrument', False)}, {part('instrumenttype', True)}, {part('comment', True)})"
    return rf"trim(regexp_replace(regexp_replace({joined}, '[^-\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def instruments(src: str, name: str = "ins", keep_path: bool = False) -> list[str]:
    """Match level by level with the rules as a table, then read the solution of the leaf."""
    rows = ", ".join(
        "(" + ", ".join([str(i)] + ["'" + v.replace("'", "''") + "'" for v in rule]) + ")"
        for i, rule in enumerate(DEFAULT_INSTRUMENTS)
    )
    ctes = [
        f"rules(ord, {', '.join(LEVELS)}, resolution, solution) AS (VALUES {rows})",
        f"txt AS (SELECT *, '. ' || {instrument_text_expr()} || ' .' AS t FROM {src})",
        "lvl0 AS (SELECT DISTINCT t FROM txt)",
    ]
    done: list[str] = []
    for depth, level in enumerate(LEVELS):
        same = "".join(f" AND r.{x} = l.{x}" for x in done)
        group = ", ".join(["l.t"] + [f"l.{x}" for x in done])
        inside = "EXISTS (SELECT 1 FROM rules r WHERE true" + same + ")"
        ctes.append(
            f"lvl{depth + 1} AS (SELECT {group}, CASE WHEN {inside} THEN coalesce(arg_min(r.{level}, r.ord), 'not found') END "
            rf"AS {level} FROM lvl{depth} l LEFT JOIN rules r ON regexp_matches(l.t, '(\b|^|$)' || r.{level} || '(\b|^|$)'){same} "
            f"GROUP BY {group})"
        )
        done.append(level)
    keys = ", ".join(LEVELS)
    rank = "CASE resolution " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(RESOLUTIONS)) + " END"
    ctes.append(f"leaf AS (SELECT {keys}, arg_min(solution, {rank}) AS sol FROM rules GROUP BY {keys})")
    path = ", ".join(f"lvl5.{x}" for x in LEVELS)
    extra = f", txt.t AS instrument_text, {path}" if keep_path else ""
    join = " AND ".join(f"leaf.{x} = lvl5.{x}" for x in LEVELS)
    part = "trim(split_part(sol, ',', {}))"
    ctes.append(
        f"{name} AS (SELECT txt.* EXCLUDE (t) REPLACE (coalesce({part.format(1)}, instrument) AS instrument, "
        f"coalesce({part.format(2)}, instrumenttype) AS instrumenttype, coalesce({part.format(3)}, txt.resolution) AS resolution, "
        f"coalesce(nullif(trim(split_part(split_part(sol, ',', 2), '-', 2)), ''), ionization) AS ionization){extra} "
        f"FROM txt JOIN lvl5 ON txt.t = lvl5.t LEFT JOIN leaf ON {join})"
    )
    return ctes


def adducts() -> str:
    rows = ", ".join(f"('{k}', '{c}', {m}::DOUBLE, '{i}')" for k, c, m, i in default_adducts())
    return f"adducts(known_adduct, canonical, massdiff, mode) AS (VALUES {rows})"


def strip_adduct_expr(col: str = "precursortype") -> str:
    bare = rf"regexp_replace({col}, '\(|\)|(.*\[)|(\]([\d\+\-\*]*)?)', '', 'g')"
    return f"CASE WHEN regexp_matches({bare}, '(^|[^M])[+-]$') THEN left({bare}, -1) ELSE {bare} END"


def adduct(src: str, name: str = "adu") -> list[str]:
    gc = r"coalesce(regexp_matches(instrumenttype, '(?i)\bGC\b'), false)"
    return [
        adducts(),
        f"{name} AS (SELECT s.* REPLACE (CASE WHEN {gc} THEN precursortype ELSE coalesce(a.canonical, precursortype) END "
        f"AS precursortype) FROM (SELECT *, {strip_adduct_expr()} AS bare FROM {src}) s0 "
        "LEFT JOIN adducts a ON a.known_adduct = s0.bare)".replace("s.*", "s0.* EXCLUDE (bare)"),
    ]


def facts() -> str:
    return (
        "facts AS (SELECT canonical, arg_max(massdiff, CASE WHEN mode = 'positive' THEN 1 ELSE 0 END) AS massdiff, "
        "bool_or(mode = 'positive') AS in_pos, bool_or(mode = 'negative') AS in_neg FROM adducts GROUP BY 1)"
    )


NUMBER = r"(-?\d+[.,]?\d*(?:[Ee][+-]?\d+)?)"


def first_number(col: str) -> str:
    return f"try_cast(replace(nullif(regexp_extract({col}, '{NUMBER}', 1), ''), ',', '.') AS DOUBLE)"


def count_in(formula: str, symbol: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({formula}, '{symbol}(\d|[A-Z]|$)') THEN "
        rf"coalesce(try_cast(regexp_extract({formula}, '{symbol}(\d*)', 1) AS INT), 1) ELSE 0 END"
    )


def chno_mass(formula: str, masses: tuple = (12.0, 1.0078250322, 14.003074004, 15.994914619)) -> str:
    parts = [f"{m}::DOUBLE * ({count_in(formula, s)})" for s, m in zip("CHNO", masses)]
    return f"CASE WHEN {formula} IS NOT NULL AND {formula} <> '' THEN " + " + ".join(parts) + " END"


INCHI_FORMULA = "nullif(regexp_extract(inchi, '(?i)^InChI=1S?/([A-Za-z0-9.]+)', 1), '')"
NEUTRAL = f"coalesce({chno_mass(INCHI_FORMULA)}, {chno_mass('formula')})"
NEEDS = f"coalesce({first_number('precursormz')} <= 0, true)"


def recompute(src: str, name: str = "rec") -> list[str]:
    return [
        adducts(),
        facts(),
        f"{name} AS (SELECT s.*, CASE WHEN {NEEDS} THEN coalesce({NEUTRAL} + massdiff, {first_number('precursormz')}) "
        f"ELSE {first_number('precursormz')} END AS precursor FROM {src} s LEFT JOIN facts ON canonical = precursortype)",
    ]


IONMODE = (
    "CASE WHEN regexp_matches(ionmode, '(?i)^(p|\\+)') THEN 'positive' "
    "WHEN regexp_matches(ionmode, '(?i)^(n|-)') THEN 'negative' ELSE ionmode END"
)
PREDICTED = (
    f"(coalesce(predicted, '') <> 'false' AND ({has('comment', SILICO)} OR coalesce(predicted, '') = 'true' OR "
    f"(NOT coalesce(contains(filename, 'MSMS_Public'), false) AND regexp_matches(coalesce(filename, '') || ' ' || coalesce(name, ''), '{SILICO}'))))"
)


def modes(src: str, name: str = "mod") -> str:
    return f"{name} AS (SELECT * REPLACE ({IONMODE} AS ionmode, {PREDICTED} AS predicted) FROM {src})"


DEFAULT_ADDUCT = (
    "CASE WHEN predicted AND coalesce(precursortype, '') = '' AND ionmode = 'positive' THEN '[M+H]+' "
    "WHEN predicted AND coalesce(precursortype, '') = '' AND ionmode = 'negative' THEN '[M-H]-' ELSE precursortype END"
)
BARE_M = (
    "CASE WHEN precursortype = 'M' AND ionmode = 'positive' THEN '[M]+' "
    "WHEN precursortype = 'M' AND ionmode = 'negative' THEN '[M]-' ELSE precursortype END"
)


def check_adduct(src: str, name: str = "chk") -> list[str]:
    reason = (
        r"CASE WHEN coalesce(regexp_matches(instrumenttype, '\bGC\b'), false) AND coalesce(precursortype, '') = '' THEN NULL "
        r"WHEN NOT coalesce(regexp_matches(precursortype, '(?i)m\]?(\-|\+)'), false) THEN 'bad_adduct' "
        "WHEN ionmode = 'positive' AND coalesce(in_neg, false) THEN 'neg_in_pos' "
        "WHEN ionmode = 'negative' AND coalesce(in_pos, false) THEN 'pos_in_neg' END"
    )
    return [
        adducts(),
        facts(),
        f"{name}_a AS (SELECT * REPLACE ({DEFAULT_ADDUCT} AS precursortype) FROM {src})",
        f"{name}_b AS (SELECT * REPLACE ({BARE_M} AS precursortype) FROM {name}_a)",
        f"{name} AS (SELECT s.*, {reason} AS adduct_reason FROM {name}_b s LEFT JOIN facts f ON f.canonical = s.precursortype)",
    ]


MS_LEVEL = (
    "CASE WHEN len(regexp_extract_all(coalesce(mslevel, ''), '\\d')) = 0 THEN '2' "
    "ELSE array_to_string(regexp_extract_all(mslevel, '\\d')[1:2], '-') END"
)
_RT = (
    r"(?i)(-?\d+[.,]?\d*(?:E[+-]?\d+)?)\W?"
    r"(milliseconds|millisecond|ms|minutes|minute|min|m|seconds|second|sec|s)"
)
RT = (
    f"CASE WHEN coalesce(regexp_extract(rt, '{_RT}', 2), '') = '' THEN try_cast(replace(trim(rt), ',', '.') AS DOUBLE) "
    f"WHEN lower(regexp_extract(rt, '{_RT}', 2)) LIKE 'm%s' AND lower(regexp_extract(rt, '{_RT}', 2)) <> 'minutes' "
    f"THEN {first_number('rt')} / 60000 WHEN lower(regexp_extract(rt, '{_RT}', 2)) LIKE 's%' THEN {first_number('rt')} / 60 "
    f"ELSE {first_number('rt')} END"
)
NO_STRUCTURE = "coalesce(nullif(smiles, ''), nullif(inchi, ''), nullif(inchikey, '')) IS NULL"
IS_GC = r"(coalesce(contains(filename, '_GC'), false) OR coalesce(regexp_matches(instrumenttype, '\bGC\b'), false))"


def normalized(src: str, name: str = "nrm") -> list[str]:
    """All metadata steps; adds ``reason`` (first failing check) and DOUBLE ``precursor``."""
    return [
        empties(src),
        repair("emp"),
        f"stc AS (SELECT * REPLACE ({ionization_expr()} AS ionization), CASE WHEN len(peaks) = 0 THEN 'no_peaks' "
        f"WHEN {NO_STRUCTURE} THEN 'no_structure' END AS reason0 FROM rep)",
        *instruments("stc"),
        *adduct("ins"),
        *recompute("adu"),
        modes("rec"),
        *check_adduct("mod"),
        f"{name} AS (SELECT * REPLACE ({MS_LEVEL} AS mslevel, {RT} AS rt), {IS_GC} AS is_gc, "
        f"coalesce(reason0, adduct_reason, CASE WHEN {IS_GC} THEN NULL WHEN precursor IS NULL THEN 'precursor_invalid' "
        "WHEN precursor <= 0 THEN 'precursor_le_zero' END) AS reason FROM chk)",
    ]


# --- peaks ----------------------------------------------------------------------------------

TOP = "list_max(list_transform(peaks, lambda p: p.intensity))"
SORTED = "list_sort(peaks)"
POSITIVE = "list_filter(peaks, lambda p: p.intensity > 0)"
SCALED = (
    f"CASE WHEN {TOP} > 0 THEN list_transform(list_zip(peaks, list_resize([]::DOUBLE[], len(peaks), {TOP})), "
    "lambda z: {'mz': z[1].mz, 'intensity': z[1].intensity / z[2]}) ELSE [] END"
)
ENTROPY = (
    "CASE WHEN list_sum(list_transform(peaks, lambda p: p.intensity)) > 0 THEN "
    "(SELECT -sum(s * log2(s)) FROM (SELECT unnest(list_transform(peaks, lambda p: p.intensity)) / "
    "list_sum(list_transform(peaks, lambda p: p.intensity)) AS s) WHERE s > 0) ELSE 0 END"
)


def cut(limit: str) -> str:
    return f"list_filter(peaks, lambda p: {limit} IS NULL OR p.mz < {limit} + 5.0)"


def top_k(k: int) -> str:
    ranked = "list_reverse_sort(list_transform(peaks, lambda p: {'i': p.intensity, 'm': p.mz}))"
    return (
        f"CASE WHEN len(peaks) > {k} THEN list_sort(list_transform({ranked}[1:{k}], "
        "lambda p: {'mz': p.m, 'intensity': p.i})) ELSE peaks END"
    )


RANGE = "list_filter(peaks, lambda p: p.mz >= 50 AND p.mz <= 2000)"
N_HIGH = f"(SELECT count(*) FROM (SELECT unnest(peaks).intensity AS i) WHERE i / {TOP} * 100 >= 5)"


def accepted(src: str, name: str = "acc") -> list[str]:
    """Peak filters with the first failing check; ``src`` has reason, precursor, is_gc."""
    live = "reason IS NULL"
    limit = "CASE WHEN NOT is_gc THEN precursor END"
    steps = [
        (f"list_filter(list_sort(peaks), lambda p: p.intensity > 0)", "CASE WHEN len(peaks) < 3 THEN 'min_peaks' END"),
        (cut(f"({limit})"), "CASE WHEN len(peaks) = 0 THEN 'all_above_precursor' END"),
        (SCALED.replace("[] END", "peaks END"), "NULL"),
        (RANGE, "CASE WHEN len(peaks) = 0 THEN 'mz_range' END"),
        ("peaks", f"CASE WHEN {N_HIGH} < 2 THEN 'min_high_peaks' END"),
    ]
    ctes, prev = [], src
    for i, (value, reason) in enumerate(steps):
        ctes.append(f"{name}_p{i} AS (SELECT * REPLACE (CASE WHEN {live} THEN {value} ELSE peaks END AS peaks) FROM {prev})")
        ctes.append(f"{name}_r{i} AS (SELECT * REPLACE (coalesce(reason, {reason}) AS reason) FROM {name}_p{i})")
        prev = f"{name}_r{i}"
    ctes += [
        f"{name}_e AS (SELECT *, CASE WHEN {live} THEN {ENTROPY} END AS entropy FROM {prev})",
        f"{name} AS (SELECT * REPLACE (coalesce(reason, CASE WHEN entropy < 0.5 THEN 'low_entropy' END) AS reason) FROM {name}_e)",
    ]
    return ctes


# --- fingerprint ----------------------------------------------------------------------------

RELATIVE = (
    f"CASE WHEN {TOP} <> 0 THEN list_transform(list_zip(peaks, list_resize([]::DOUBLE[], len(peaks), {TOP})), "
    "lambda z: {'mz': z[1].mz, 'intensity': z[1].intensity / z[2] * 100}) END"
)
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def relative(src: str, name: str = "rel") -> str:
    return f"{name} AS (SELECT * REPLACE ({RELATIVE} AS peaks) FROM {src})"


def top_ions(src: str, name: str = "top") -> list[str]:
    """Input relative peaks; output the strongest ten, scaled again."""
    return [
        f"{name}_f AS (SELECT * REPLACE (list_transform(list_sort(list_transform(list_filter(list_zip(peaks, "
        f"list_resize([]::DOUBLE[], len(peaks), {TOP})), lambda z: z[1].intensity + 1e-7 >= 0.1::DOUBLE * z[2]), "
        "lambda z: {'o': -z[1].intensity, 'm': z[1].mz}))[1:10], lambda p: {'mz': p.m, 'intensity': -p.o}) AS peaks) "
        f"FROM {src})",
        relative(f"{name}_f", name),
    ]


def histogram(src: str, base: int, length: int, width: int, name: str) -> list[str]:
    """``record_id, digits`` by unnesting the peaks; NULL when a digit has no letter."""
    return [
        f"{name}_b AS (SELECT record_id, ((trunc(p.mz / {width})::BIGINT % {length}) + {length}) % {length} AS b, "
        f"sum(p.intensity ORDER BY i) AS x FROM (SELECT record_id, unnest(peaks) AS p, generate_subscripts(peaks, 1) AS i FROM {src}) "
        "GROUP BY 1, 2)",
        f"{name}_g AS (SELECT r.record_id, g.b, coalesce(x, 0::DOUBLE) AS x FROM (SELECT DISTINCT record_id FROM {name}_b) r "
        f"CROSS JOIN (SELECT unnest(range({length})) AS b) g LEFT JOIN {name}_b h ON h.record_id = r.record_id AND h.b = g.b)",
        f"{name}_m AS (SELECT record_id, max(x) AS top FROM {name}_g GROUP BY 1)",
        f"{name}_d AS (SELECT g.record_id, b, trunc(1e-7 + {base - 1} * x / top)::BIGINT AS d FROM {name}_g g "
        f"JOIN {name}_m m ON m.record_id = g.record_id AND top <> 0)",
        f"{name} AS (SELECT record_id, CASE WHEN bool_and(d BETWEEN -36 AND 35) THEN "
        f"string_agg(substr('{DIGITS}', (((d % 36) + 36) % 36 + 1)::INT, 1), '' ORDER BY b) END AS digits FROM {name}_d GROUP BY 1)",
    ]


def base36(col: str) -> str:
    n = "(" + " + ".join(f"substr({col}, {i + 1}, 1)::INT * {3 ** (9 - i)}" for i in range(10)) + ")"
    letters = " || ".join(f"substr('{DIGITS}', ({n} // {36 ** e} % 36 + 1)::INT, 1)" for e in (3, 2, 1, 0))
    return f"CASE WHEN regexp_matches({col}, '^[012]+$') THEN {letters} END"


def ion_hash(src: str, name: str = "hsh") -> str:
    return (
        f"{name} AS (SELECT record_id, substr(sha256(string_agg(m || ':' || i, ' ' ORDER BY m, i DESC)), 1, 20) AS block "
        "FROM (SELECT record_id, trunc((p.mz + 1e-7) * 1000000)::BIGINT AS m, trunc(p.intensity + 1e-7)::BIGINT AS i FROM "
        f"(SELECT record_id, unnest(peaks) AS p FROM {src})) GROUP BY 1)"
    )


def splash(src: str, name: str = "spl") -> list[str]:
    """``record_id, splash``."""
    return [
        relative(src),
        *top_ions("rel"),
        *histogram("top", 3, 10, 5, "pre"),
        *histogram("rel", 10, 10, 100, "sim"),
        ion_hash("rel"),
        f"{name} AS (SELECT s.record_id, 'splash10-' || {base36('pre.digits')} || '-' || sim.digits || '-' || block AS splash "
        f"FROM {src} s LEFT JOIN pre USING (record_id) LEFT JOIN sim USING (record_id) LEFT JOIN hsh USING (record_id))",
    ]


def with_splash(src: str, name: str = "fin") -> list[str]:
    return [*splash(src), f"{name} AS (SELECT s.*, spl.splash FROM {src} s JOIN spl USING (record_id))"]


RICHNESS = (
    " + ".join(f"length(coalesce({c}, ''))" for c in [*TEXTS, "splash"])
    + f" + length({peak_text(sep=chr(10))})"
)


def deduplicated(src: str, name: str = "dup") -> str:
    return (
        f"{name} AS (SELECT *, trim(inchikey) <> '' AND row_number() OVER (PARTITION BY splash, inchikey "
        f"ORDER BY size DESC, record_id) > 1 AS is_duplicate FROM (SELECT *, {RICHNESS} AS size FROM {src}))"
    )


# --- enrichment -----------------------------------------------------------------------------

COMPOUND_FIELDS = ["inchi", "smiles", "formula", "name", "exactmass", "averagemass"]
CLASS_FIELDS = list(fx.ONTOLOGY_EXPRS)[1:]
VALID_KEY = "coalesce(regexp_full_match(inchikey, '(?i)[A-Z]{14}-[A-Z]{10}-[NO]|[A-Z]{14}'), false)"


def one_per_key(table: str, key: str, fields: list[str], name: str) -> str:
    order = ", ".join(f"{f} NULLS FIRST" for f in fields)
    return (
        f"{name} AS (SELECT * FROM (SELECT {key}, {', '.join(fields)}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn "
        f"FROM {table}) WHERE rn = 1)"
    )


DERIVED = ["inchi", "inchikey", "smiles", "formula", "exactmass", "averagemass"]


def resolved(src: str, name: str = "res") -> list[str]:
    """``src`` needs the six derived columns; masses may be NULL."""
    pick = ", ".join(
        f"CASE WHEN a.structure IS NOT NULL THEN a.{c} WHEN b.structure IS NOT NULL THEN b.{c} ELSE s.{c} END AS {c}"
        for c in DERIVED
    )
    both = ", ".join(DERIVED)
    return [
        compounds(),
        f"st0 AS (SELECT inchi AS structure, {both} FROM compounds UNION ALL SELECT smiles, {both} FROM compounds)",
        one_per_key("st0", "structure", DERIVED, "st"),
        f"{name}_j AS (SELECT s.* REPLACE ({pick}) FROM {src} s LEFT JOIN st a ON a.structure = s.inchi LEFT JOIN st b ON b.structure = "
        r"CASE WHEN contains(s.smiles, 'InChI=') THEN s.smiles ELSE regexp_replace(s.smiles, '\|[\s\S]*', '') END)",
        f"{name} AS (SELECT * REPLACE (coalesce(exactmass, {chno_mass('ff')}) AS exactmass, "
        f"coalesce(averagemass, {chno_mass('ff', (12.011, 1.008, 14.007, 15.999))}) AS averagemass) FROM "
        f"(SELECT *, coalesce({INCHI_FORMULA}, nullif(formula, '')) AS ff FROM {name}_j))",
    ]


def enriched(src: str, name: str = "enr") -> list[str]:
    cols = ", ".join(f"coalesce(c.{f}, s.{f}) AS {f}" for f in COMPOUND_FIELDS)
    return [
        compounds(),
        one_per_key("compounds", "inchikey", COMPOUND_FIELDS, "cmp"),
        f"{name} AS (SELECT s.* REPLACE ({cols}) FROM {src} s LEFT JOIN cmp c ON c.inchikey = s.inchikey)",
    ]


def classed(src: str, name: str = "ont") -> list[str]:
    cols = ", ".join(f"coalesce(o.{f}, 'NOT FOUND') AS {f}" for f in CLASS_FIELDS)
    return [
        ontologies(),
        one_per_key("ontologies", "inchikey", CLASS_FIELDS, "onto"),
        f"{name} AS (SELECT s.*, {cols} FROM {src} s LEFT JOIN onto o ON o.inchikey = s.inchikey)",
    ]


POLARITY = "CASE WHEN ionmode IN ('positive', 'negative') THEN ionmode END"
CHROMATOGRAPHY = "CASE WHEN coalesce(regexp_matches(instrumenttype, '(?i)GC|EI'), false) THEN 'GC' ELSE 'LC' END"
ORIGIN = "CASE WHEN predicted THEN 'in_silico' ELSE 'experimental' END"


def classes(src: str, name: str = "cls") -> str:
    return f"{name} AS (SELECT *, {POLARITY} AS polarity, {CHROMATOGRAPHY} AS chromatography, {ORIGIN} AS origin FROM {src})"


GRID = (
    "grid AS (SELECT * FROM (VALUES ('positive'), ('negative')) a(polarity), (VALUES ('LC'), ('GC')) b(chromatography), "
    "(VALUES ('experimental'), ('in_silico')) c(origin))"
)


def cleaned(src: str = "raw") -> list[str]:
    return [*normalized(src), *accepted("nrm")]


def curated() -> list[str]:
    """Copies in, duplicates out, cleaned, resolved, enriched, classified; ``cur`` has ``reason``."""
    return [
        *copies(),
        *with_splash("cp"),
        deduplicated("fin"),
        "uni AS (SELECT * EXCLUDE (size, is_duplicate) FROM dup WHERE NOT coalesce(is_duplicate, false))",
        *cleaned("uni"),
        "liv AS (SELECT *, NULL::DOUBLE AS exactmass, NULL::DOUBLE AS averagemass FROM acc WHERE reason IS NULL)",
        *resolved("liv"),
        *enriched("res"),
        *classed("enr"),
        classes("ont"),
        f"cur AS (SELECT * REPLACE (coalesce(CASE WHEN NOT {VALID_KEY} THEN 'bad_inchikey' END, "
        "CASE WHEN polarity IS NULL THEN 'unknown_ionmode' END) AS reason) FROM cls)",
        "kept AS (SELECT * FROM cur WHERE reason IS NULL)",
        "rejected AS (SELECT record_id, 'duplicate' AS reason FROM dup WHERE coalesce(is_duplicate, false) UNION ALL "
        "SELECT record_id, reason FROM acc WHERE reason IS NOT NULL UNION ALL "
        "SELECT record_id, reason FROM cur WHERE reason IS NOT NULL)",
    ]


# --- de novo --------------------------------------------------------------------------------

MASSES = {"Cl": 34.9688527, "S": 31.972071174, "O": 15.994914619, "N": 14.003074004, "C": 12.0, "H": 1.0078250322}


def denovo(name: str = "dn") -> list[str]:
    return [
        _peaks_cte("dpk", fx.DENOVO_MZ, fx.INTENSITY),
        f"{name} AS (SELECT o_orderkey AS record_id, {fx.DENOVO_FORMULA} AS formula, dpk.peaks FROM orders "
        "JOIN dpk ON dpk.pk_id = o_orderkey)",
    ]


def formulas() -> str:
    counts = ", ".join(
        f"CASE WHEN regexp_matches(formula, '{s}([0-9A-Z]|$)') THEN coalesce(try_cast(regexp_extract(formula, '{s}(\\d*)', 1) AS INT), 1) "
        f"ELSE 0 END AS max_{s}"
        for s in MASSES
    )
    simple = "NOT regexp_matches(formula, 'Cl')"
    return f"frm AS (SELECT formula, {simple} AS is_simple, {counts} FROM (SELECT DISTINCT formula FROM dn))"


def candidates(lightest: float | None = None) -> list[str]:
    """The lattice up to the heaviest window; with ``lightest`` of the peaks from there on, and down to their lightest window."""
    ranges = ", ".join(f"(SELECT unnest(range(max_{s} + 1))::INT AS n_{s}) x_{s}" for s in MASSES)
    mass = " + ".join(f"n_{s} * {m}::DOUBLE" for s, m in MASSES.items())
    return [
        formulas(),
        "lim AS (SELECT formula, (max(p.mz) - 1.0078250322::DOUBLE) * (1 + 5 / 1e6) AS mass_limit FROM "
        "(SELECT formula, unnest(peaks) AS p FROM dn) GROUP BY 1)"
        if lightest is None
        else "lim AS (SELECT formula, (max(p.mz) - 1.0078250322::DOUBLE) * (1 + 5 / 1e6) AS mass_limit, "
        "(min(p.mz) - 1.0078250322::DOUBLE) * (1 - 5 / 1e6) - 1e-6::DOUBLE AS mass_floor FROM "
        f"(SELECT formula, unnest(peaks) AS p FROM dn) WHERE p.mz >= {lightest} GROUP BY 1)",
        f"can AS (SELECT * FROM (SELECT f.formula, is_simple, max_C, lim.* EXCLUDE (formula), {', '.join('n_' + s for s in MASSES)}, 0.0::DOUBLE + {mass} AS mass "
        f"FROM frm f JOIN lim USING (formula), {', '.join('LATERAL ' + r for r in ranges.split(', '))}) WHERE mass <= mass_limit{'' if lightest is None else ' AND mass >= mass_floor'})",
    ]


DBE_SIMPLE = "(n_C - n_H / 2.0 + n_N / 2.0 + 1)"
PLAUSIBLE_SIMPLE = (
    f"(n_C > 0 AND {DBE_SIMPLE} >= 0 AND {DBE_SIMPLE} = floor({DBE_SIMPLE}) AND n_H::DOUBLE / nullif(n_C, 0) BETWEEN 0.2 AND 3.0)"
)
DBE_GENERAL = "(1 + (2 * n_C + n_N - n_H - n_Cl) / 2.0)"
PLAUSIBLE_GENERAL = (
    f"(round_even(mass, 0)::BIGINT % 2 = n_N % 2 AND {DBE_GENERAL} >= 0 AND {DBE_GENERAL} = floor({DBE_GENERAL}) AND n_C > 0 AND "
    "n_H::DOUBLE / nullif(n_C, 0) BETWEEN 0.2 AND 3.0 AND n_O::DOUBLE / nullif(n_C, 0) <= 1.2 AND n_N::DOUBLE / nullif(n_C, 0) <= 1.3 "
    "AND n_S::DOUBLE / nullif(n_C, 0) <= 0.8)"
)
PLAUSIBLE = f"CASE WHEN is_simple THEN {PLAUSIBLE_SIMPLE} ELSE {PLAUSIBLE_GENERAL} END"


def _part(symbol: str, n: str) -> str:
    return f"CASE WHEN {n} > 1 THEN concat('{symbol}', {n}) WHEN {n} = 1 THEN '{symbol}' ELSE '' END"


HILL = " || ".join(
    [_part("C", "n_C"), _part("H", "(n_H + 1)"), *[_part(s, f"n_{s}") for s in ("Cl", "N", "O", "S")], "'+'"]
)


def hits() -> list[str]:
    return [
        *candidates(),
        "tgt AS (SELECT *, target * (1 - 5 / 1000000.0::DOUBLE) AS lo, target * (1 + 5 / 1000000.0::DOUBLE) AS hi FROM "
        "(SELECT DISTINCT formula, p.mz AS mz, p.mz - 1.0078250322::DOUBLE AS target FROM (SELECT formula, unnest(peaks) AS p FROM dn)) "
        "WHERE target > 0)",
        f"hit AS (SELECT t.formula, t.mz, t.target, c.* EXCLUDE (formula), round((mass - target) / target * 1000000, 2) + 0.0::DOUBLE AS error_ppm "
        f"FROM tgt t JOIN can c ON c.formula = t.formula AND c.mass BETWEEN t.lo AND t.hi WHERE {PLAUSIBLE})",
    ]


def best() -> list[str]:
    return [
        *hits(),
        f"bst AS (SELECT formula, mz, {HILL} AS fragment, error_ppm, round(mass, 6) AS fragment_mass FROM (SELECT *, row_number() OVER "
        "(PARTITION BY formula, mz ORDER BY n_Cl, n_S, n_O, n_N, n_C, n_H) AS rn FROM hit) WHERE rn = 1)",
    ]
