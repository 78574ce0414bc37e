"""DuckDB twins of the queries, written from the operators' definitions."""

from __future__ import annotations

from .fixtures import CORONER_SQL, NOISY_SQL, RAW_SQL

_T = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"
_FOLD = "translate({0}, 'áàâãäéèêëíìîïóòôõöúùûüç', 'aaaaaeeeeiiiiooooouuuuc')"


def _period(c: str) -> str:
    return _FOLD.format(rf"lower(regexp_replace(nullif(trim({c}), ''), '\s+', ' ', 'g'))")


def _label(p: str) -> str:
    return f"CASE {p} WHEN 'de madrugada' THEN 'De madrugada' WHEN 'pela manha' THEN 'Pela manhã' WHEN 'a tarde' THEN 'À tarde' WHEN 'a noite' THEN 'À noite' WHEN 'em hora incerta' THEN 'Em hora incerta' ELSE upper(substring({p}, 1, 1)) || substring({p}, 2) END"


def _sort(p: str) -> str:
    return f"CASE {p} WHEN 'de madrugada' THEN 1 WHEN 'pela manha' THEN 2 WHEN 'a tarde' THEN 3 WHEN 'a noite' THEN 4 WHEN 'em hora incerta' THEN 5 ELSE 99 END"


def _dated(c: str, forms: tuple[tuple[str, str], ...]) -> str:
    return "coalesce(" + ", ".join(rf"CASE WHEN regexp_matches({c}, '{p}') THEN try_strptime(regexp_extract({c}, '{p}', 1), '{f}')::date END" for p, f in forms) + ")"


_FORMS = (("^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$", "%Y-%m-%d"), ("^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", "%d/%m/%Y"), ("^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$", "%d-%m-%Y"), ("^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", "%m/%d/%Y"), ("^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$", "%m-%d-%Y"))
_SERIAL = rf"CASE WHEN regexp_matches(t, '^[0-9]{{1,9}}(\.[0-9]+)?$') AND floor(t::double) BETWEEN 41275 AND 73050 THEN date '1899-12-30' + floor(t::double)::int END"
_ISO13 = f"CASE WHEN year({_dated('t', _FORMS)}) >= 2013 THEN strftime({_dated('t', _FORMS)}, '%Y-%m-%d') END"
_VOID = rf"(t = '' OR regexp_matches(lower(t), '^n[ãa]o\s+informado$') OR regexp_matches(t, '^#+$'))"
_NULLS = "regexp_matches(t, '(?i)^(null)+$')"


def _cells(select: str) -> str:
    return f"WITH noisy AS ({NOISY_SQL}), cells AS (SELECT id, v, {_T} AS t FROM noisy) SELECT id, {select} FROM cells"


def _is(test: str, name: str) -> str:
    return f"coalesce(({test})::int, 0) AS {name}"


_CLOCK = "printf('%02d:%02d:%02d', ({0} // 3600)::int, (({0} // 60) % 60)::int, ({0} % 60)::int)"
_FRACTION = r"CASE WHEN regexp_matches(t, '^[0-9]*\.?[0-9]+$') AND t::double < 1 THEN round(t::double * 86400)::int END"


def _hm(pattern: str) -> str:
    h, m = (f"regexp_extract(t, '{pattern}', {k})" for k in (1, 2))
    return f"CASE WHEN regexp_matches(t, '{pattern}') AND try_cast({h} AS int) <= 23 AND try_cast({m} AS int) <= 59 THEN lpad({h}, 2, '0') || ':' || lpad({m}, 2, '0') END"


_HMS = "CASE WHEN regexp_matches(t, '^[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$') AND split_part(t, ':', 1)::int <= 23 AND split_part(t, ':', 2)::int <= 59 AND split_part(t, ':', 3)::int <= 59 THEN lpad(split_part(t, ':', 1), 2, '0') || ':' || lpad(split_part(t, ':', 2), 2, '0') || ':' || lpad(split_part(t, ':', 3), 2, '0') END"
_TIME = rf"""coalesce({_HMS}, {_hm('^([0-9]{1,2}):([0-9]{1,2})$')}, {_hm('^([0-9]{1,2})[hH]([0-9]{1,2})$')}, CASE WHEN {_FRACTION} < 86400 THEN {_CLOCK.format(f'({_FRACTION})')} END,
  CASE WHEN ({_FRACTION}) IS NULL THEN {_hm(r'^([0-9]{1,2})\.([0-9]{1,2})$')} END, CASE WHEN ({_FRACTION}) IS NULL AND regexp_matches(t, '^[0-9]{{1,4}}$') AND try_cast(t AS int) <= 2359 AND try_cast(t AS int) % 100 <= 59 THEN lpad((t::int // 100)::varchar, 2, '0') || ':' || lpad((t::int % 100)::varchar, 2, '0') END)"""
_VERBATIM = r"regexp_matches(t, '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$')"
_CLEAN_DATE = rf"CASE WHEN {_VOID} OR {_NULLS} THEN '' ELSE coalesce({_ISO13}, CASE WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[ T]') THEN strftime(try_strptime(split_part(replace(t, 'T', ' '), ' ', 1), '%Y-%m-%d'), '%Y-%m-%d') END, strftime({_SERIAL}, '%Y-%m-%d'), '') END"
_CLEAN_TIME = f"CASE WHEN {_VOID} OR {_NULLS} THEN '' WHEN {_VERBATIM} THEN t ELSE coalesce({_TIME}, '') END"
_GENERAL = rf"CASE WHEN regexp_matches(lower(t), '^n[ãa]o\s+informado$') OR {_NULLS} THEN '' ELSE t END"


def _numeric() -> str:
    x = "t"
    for pattern, by in ((r"(-?[0-9]+),([0-9]+)", r"\1.\2"), (r"(-?[0-9]+)\.([0-9]*),([0-9]+)", r"\1.\2\3"), (r"\.{2,}", "."), (",{2,}", "."), ("[,.][,.]", "."), ("[,.]$", ""), ("^(-)[,.]", r"\1")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_NUMERIC = rf"CASE WHEN {_VOID} THEN '' WHEN regexp_matches(n, '^-?[0-9]*\.?[0-9]*$') AND n NOT IN ('', '-', '.') THEN n ELSE coalesce(replace(regexp_extract(n, '(-?[0-9]+)([,.][0-9]+)?', 0), ',', '.'), '') END"
_NUMBER = r"CASE WHEN regexp_matches(s, '^-?[0-9]+(\.[0-9]+)?$') THEN s::double END"
_SEPARATED = r"""(SELECT CASE WHEN contains(w, ',') AND contains(w, '.') AND strpos(reverse(w), ',') < strpos(reverse(w), '.') THEN replace(replace(w, '.', ''), ',', '.') WHEN contains(w, ',') AND contains(w, '.') THEN replace(w, ',', '') ELSE replace(w, ',', '.') END FROM (SELECT regexp_replace(v, '\s+', '', 'g') AS w))"""
_DESCRIBED = "regexp_matches(replace(lower(strip_accents(trim(v))), ' ', '_'), 'madrugada|manha|tarde|noite|durante|periodo|descr|hora_incerta|policia|militar|registrado|nao_informado|informado')"
_DESCRIPTIVE = rf"({_DESCRIBED} OR (NOT contains(v, ':') AND length(regexp_replace(v, '[^\p{{L}}\s]', '', 'g')) > strlen(v) // 2))"
_INTEGER = rf"""CASE WHEN {_VOID} THEN '' WHEN regexp_matches(t, '^[0-9]{{5}}-[0-9]{{3}}$') OR regexp_matches(t, '^[0-9]+(-[0-9]+)+$') THEN v
  WHEN contains(regexp_replace(t, '[^0-9-]', '', 'g'), '-') AND (starts_with(v, '-') OR regexp_matches(regexp_replace(t, '[^0-9-]', '', 'g'), '^-[0-9]*$')) THEN CASE regexp_replace(t, '[^0-9]', '', 'g') WHEN '' THEN '' ELSE '-' || regexp_replace(t, '[^0-9]', '', 'g') END ELSE regexp_replace(t, '[^0-9]', '', 'g') END"""

_R = "'^-?[0-9]+(\\.[0-9]+)?$'"
#: Features by CTE: raw, rows_, first_ (rows with their rank in a table's group), feat, s (with search columns).
FEATURES = rf"""WITH raw AS ({RAW_SQL}),
rows_ AS (SELECT *, substring(md5(printf('%.4f', floor(lat * 10000 + 0.5) / 10000 + 0.0) || '|' || printf('%.4f', floor(lon * 10000 + 0.5) / 10000 + 0.0)), 1, 16) AS location_hash, round(lat::decimal(20, 10), 4) AS latb, round(lon::decimal(20, 10), 4) AS lonb FROM (
  SELECT * EXCLUDE (NUM_BO, ANO_BO), ['celulares_2024', 'veiculos_2024', 'objetos_2024', 'dados_criminais_2024', 'produtividade_entorpecentes_2024'][src + 1] AS tbl, ['celular', 'veiculo', 'objeto', 'dados_criminais', 'produtividade_entorpecentes'][src + 1] AS rtype,
    trim(NUM_BO) AS num_bo, ANO_BO::int AS ano, coalesce(trim(NOME_DELEGACIA), '') AS dl, CASE WHEN src < 4 THEN nullif(trim(RUBRICA), '') END AS rub,
    CASE WHEN regexp_matches(replace(LATITUDE, ',', '.'), {_R}) THEN replace(LATITUDE, ',', '.')::double END AS lat, CASE WHEN regexp_matches(replace(LONGITUDE, ',', '.'), {_R}) THEN replace(LONGITUDE, ',', '.')::double END AS lon,
    CASE WHEN contains(DATA_OCORRENCIA_BO, '/') THEN strptime(DATA_OCORRENCIA_BO, '%d/%m/%Y')::date WHEN contains(DATA_OCORRENCIA_BO, '-') THEN DATA_OCORRENCIA_BO::date ELSE date '1899-12-30' + floor(DATA_OCORRENCIA_BO::double)::int END AS d FROM raw)
  WHERE lat BETWEEN -25 AND -19 AND lon BETWEEN -54 AND -44),
first_ AS (SELECT *, row_number() OVER (PARTITION BY num_bo, ano, dl, location_hash, tbl ORDER BY latb, lonb, id) = 1 AS f, coalesce(rub, CASE src WHEN 4 THEN 'Apreensão de Entorpecentes' ELSE 'Outros' END) AS cat, coalesce(rub, CASE src WHEN 4 THEN 'TRÁFICO DE DROGAS' ELSE 'default' END) AS sty, nullif(trim(DESCR_PERIODO), '') AS per, nullif(trim(HORA_OCORRENCIA), '') AS hr, nullif(trim(DESCR_TIPOLOCAL), '') AS tl,
  CASE (id - 1) % 3 WHEN 0 THEN strftime(try_strptime(left(DATAHORA_REGISTRO_BO, 10), '%Y-%m-%d'), '%Y-%m-%d') WHEN 1 THEN left(DATA_REGISTRO, 10) ELSE strftime(strptime(DATA_REGISTRO, '%d-%m-%Y'), '%Y-%m-%d') END AS reg FROM rows_),
feat AS (SELECT num_bo, ano AS ano_bo, dl AS delegacia, location_hash, arg_min(lat, tbl) FILTER (f) AS latitude, arg_min(lon, tbl) FILTER (f) AS longitude, arg_max(cat, tbl) FILTER (f) AS category, arg_max(sty, tbl) FILTER (f) AS sty, arg_max(d, tbl) FILTER (f AND d IS NOT NULL) AS d,
  string_agg(DISTINCT tbl, '|' ORDER BY tbl) AS source_tables, list_sort(coalesce(list(DISTINCT rub) FILTER (rub IS NOT NULL), [])) AS rubs, count(*) AS n, count(*) FILTER (rtype = 'celular') AS n_cel, count(*) FILTER (rtype LIKE 'produtividade%') AS n_prod, count(*) FILTER (rtype = 'veiculo') AS n_vei,
  string_agg(tbl || ':' || id, '|' ORDER BY tbl, id) AS records, arg_max(tl, tbl) FILTER (f AND tl IS NOT NULL) AS tl, arg_max(per, tbl) FILTER (f AND per IS NOT NULL) AS per, arg_max(hr, tbl) FILTER (f AND hr IS NOT NULL) AS hr, arg_max(NOME_DELEGACIA_CIRC, tbl) FILTER (f) AS circ, arg_max(reg, tbl) FILTER (f AND reg IS NOT NULL) AS reg, arg_max(CIDADE, tbl) FILTER (f) AS cidade, arg_max(NATUREZA_APURADA, tbl) FILTER (f) AS nat, arg_max(DESCR_CONDUTA, tbl) FILTER (f) AS cond FROM first_ WHERE WHICH GROUP BY num_bo, ano, dl, location_hash),
s AS (SELECT *, {_period('per')} AS p, CASE WHEN hr IS NOT NULL THEN split_part(hr, ':', 1)::int END AS h, list_append(rubs, category) AS cats, radians(longitude) * 6378137 AS x, ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137 AS y FROM feat)
"""
_ALL = FEATURES.replace("WHICH", "true")
_FLAT = "SELECT num_bo, ano_bo, delegacia, location_hash, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, category, sty AS rubrica_for_styling, strftime(d, '%Y-%m-%d') AS data_ocorrencia, source_tables, array_to_string(rubs, '|') AS all_rubricas, n::int AS total_records, n_cel::int AS celulares_count, n_prod::int AS produtividade_count, records, tl AS tipo_local, per AS periodo FROM feat"
_DATES = "d BETWEEN date '2024-01-05' AND date '2024-01-20'"
_CATS = "list_has_any(cats, ['Furto - click', 'Furto - view', 'Outros'])"
_PERS = "p IN ('a tarde', 'pela manha')"
_HOURS = "(h >= 22 OR h <= 14)"
# Lambert's formula on WGS-84: reduced latitudes b1 and b2, arc between them on the sphere.
_B = ["atan((1 - 1 / 298.257223563) * tan(radians({0})))".format(x) for x in ("latitude", "-23.12")]
_H = f"(pow(sin(({_B[1]} - {_B[0]}) / 2), 2) + cos({_B[0]}) * cos({_B[1]}) * pow(sin(radians(-46.15 - longitude) / 2), 2))"
_ARC = f"(2 * asin(sqrt({_H})))"
_P, _Q = f"(({_B[0]} + {_B[1]}) / 2)", f"(({_B[1]} - {_B[0]}) / 2)"
_METRES = f"6378137 * ({_ARC} - ({_ARC} - sin({_ARC})) / 2 / 298.257223563 * pow(sin({_P}) * cos({_Q}), 2) / pow(cos({_ARC} / 2), 2) - ({_ARC} + sin({_ARC})) / 2 / 298.257223563 * pow(cos({_P}) * sin({_Q}), 2) / pow(sin({_ARC} / 2), 2))"
_NEAR = f"longitude BETWEEN -46.15 - 10000 / 111320.0 AND -46.15 + 10000 / 111320.0 AND latitude BETWEEN -23.12 - 10000 / 111320.0 AND -23.12 + 10000 / 111320.0 AND {_METRES} <= 10000"
_BUCKETS = "list_distinct(list_append(rubs, category))"


def _counted(where: str) -> str:
    return f"{_ALL} SELECT category, count(*) AS count FROM s WHERE {where} GROUP BY category"


def _categories(where: str) -> str:
    return f"""{_ALL}, b AS (SELECT unnest({_BUCKETS}) AS bucket, category, sty, rubs FROM s WHERE {where})
SELECT bucket AS category, count(*) AS count, coalesce(max(sty) FILTER (category = bucket), bucket) AS rubrica_for_styling, CASE WHEN bool_or(list_contains(rubs, bucket)) THEN 'rubrica' ELSE 'derived' END AS kind FROM b GROUP BY bucket"""


_NI = "'Não informado'"
_CHARTS = f"""{_ALL}, e AS (
SELECT 'period' AS chart, coalesce({_label('p')}, {_NI}) AS label, NULL::double AS amount, {_sort('p')} AS o FROM s
UNION ALL SELECT 'weekday', coalesce(['Segunda', 'Terça', 'Quarta', 'Quinta', 'Sexta', 'Sábado', 'Domingo'][isodow(d)], {_NI}), NULL, coalesce(isodow(d), 8) FROM s
UNION ALL SELECT 'location_type', coalesce(tl, {_NI}), NULL, NULL FROM s UNION ALL SELECT 'police_circumscription', circ, NULL, NULL FROM s UNION ALL SELECT 'police_unit', coalesce(nullif(delegacia, ''), {_NI}), NULL, NULL FROM s
UNION ALL SELECT 'category', unnest({_BUCKETS}), NULL, NULL FROM s
UNION ALL SELECT 'record_type', ['Celulares', 'Veículos', 'Objetos', 'Dados criminais', 'Entorpecentes'][src + 1], NULL, NULL FROM rows_
UNION ALL SELECT 'object_type', coalesce(nullif(DESCR_TIPO_OBJETO, ''), DESCR_SUBTIPO_OBJETO), coalesce(try_cast(QUANTIDADE_OBJETO AS int), 1), NULL FROM rows_ WHERE src IN (0, 2)
UNION ALL SELECT 'vehicle_brand', concat_ws(' · ', coalesce(nullif(DESCR_MARCA_VEICULO, ''), 'Marca não informada'), DESCR_TIPO_VEICULO, ANO_MODELO), NULL, NULL FROM rows_ WHERE src = 1
UNION ALL SELECT 'phone_brand', concat_ws(' · ', coalesce(nullif(MARCA_OBJETO, ''), 'Marca não informada'), DESCR_SUBTIPO_OBJETO), coalesce(try_cast(QUANTIDADE_OBJETO AS int), 1), NULL FROM rows_ WHERE src = 0
UNION ALL SELECT 'drug_type', coalesce(nullif(DESCR_TOXICO, ''), {_NI}), replace(QTDE_GRAMAS_ARRED, ',', '.')::double, NULL FROM rows_ WHERE src = 4),
c AS (SELECT chart, label, o, count(*) AS count, sum(amount) AS amount FROM e GROUP BY chart, label, o),
r AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY coalesce(o, 0), CASE WHEN o IS NULL THEN -count ELSE 0 END, label) AS rank FROM c)
SELECT chart, rank::int AS rank, label, count, round(amount, 2) AS amount FROM r WHERE rank <= 12"""
_KEYED = r"trim(regexp_replace(upper(strip_accents({0})), '[^A-Z0-9]+', ' ', 'g'))"
_CORONER = f"""{_ALL}, cor AS ({CORONER_SQL}), k AS (SELECT id, {_KEYED.format('NUM_BO')} AS kn, ANO_BO AS ka, {_KEYED.format('DELEGACIA_REGISTRO')} AS kd,
  coalesce(try_strptime(DATA_ENTRADA_IML, '%d/%m/%Y %H:%M:%S'), try_strptime(DATA_ENTRADA_IML, '%d/%m/%Y')) AS entered FROM cor)
SELECT num_bo, delegacia, location_hash, coalesce(string_agg(k.id::varchar, ',' ORDER BY entered NULLS LAST, k.id), '') AS coroner_ids FROM s LEFT JOIN k ON {_KEYED.format('num_bo')} = kn AND ano_bo::varchar = ka AND {_KEYED.format('delegacia')} = kd AND kd <> '' GROUP BY num_bo, ano_bo, delegacia, location_hash"""
_W = "40075016.685578488"
_PYRAMID = f"""{_ALL}, z AS (SELECT unnest([10, 11, 12, 13, 14, 15]) AS zoom, unnest([4, 5, 6, 8, 10, 12]) AS cells), pts AS (SELECT s.*, zoom, cells, (x + {_W} / 2) / ({_W} / pow(2, zoom) / cells) AS u, ({_W} / 2 - y) / ({_W} / pow(2, zoom) / cells) AS w FROM s, z)
SELECT zoom, floor(floor(u) / any_value(cells))::bigint AS tile_x, floor(floor(w) / any_value(cells))::bigint AS tile_y, floor(u)::bigint AS cell_x, floor(w)::bigint AS cell_y, min(category) AS category, count(*) AS cluster_count, round(avg(x), 1) AS x, round(avg(y), 1) AS y, (count(*) = 1)::int AS is_singleton, CASE WHEN count(*) = 1 THEN min(num_bo) END AS num_bo FROM pts GROUP BY zoom, floor(u), floor(w)"""
_POINTS = f"""{_ALL}, q AS (SELECT *, (x + {_W} / 2) / ({_W} / 65536) AS u, ({_W} / 2 - y) / ({_W} / 65536) AS w FROM s)
SELECT num_bo, location_hash, delegacia, list_min(list_intersect(cats, ['Furto - click', 'Furto - view'])) AS category, floor(u)::bigint AS tile_x, floor(w)::bigint AS tile_y, round((u - floor(u)) * 4096)::int AS pixel_x, round((w - floor(w)) * 4096)::int AS pixel_y FROM q"""
_CATALOG = """WITH o AS (SELECT o_orderkey % 14 AS k, year(o_orderdate) + 25 AS year FROM orders), cat AS (SELECT DISTINCT 'cat' || k AS category, k, year FROM o),
n AS (SELECT 'cat' || k AS category, year, CASE WHEN k % 7 = 3 THEN 0 ELSE count(*) END AS rows FROM o WHERE k % 5 <> 1 GROUP BY k, year), st AS (SELECT category, cat.year, n.category IS NOT NULL AS there, coalesce(rows, 0) AS rows FROM cat LEFT JOIN n USING (category, year)),
old AS (SELECT category, year, 'a' AS h FROM cat WHERE year % 2 = 0), new AS (SELECT category, year, CASE WHEN year % 4 = 0 THEN 'a' ELSE 'b' END AS h FROM cat WHERE length(category) = 4)
"""


def _profile(column: str) -> str:
    v = f"{column}::varchar"
    return f"""SELECT '{column}' AS "column", count(*) FILTER ({v} = '') AS null_count, count(*) AS total_count, min(strlen({v}))::bigint AS min_length, max(strlen({v}))::bigint AS max_length,
  CASE WHEN bool_and(try_cast({v} AS double) IS NOT NULL) THEN min(try_cast({v} AS double)) END AS numeric_min, CASE WHEN bool_and(try_cast({v} AS double) IS NOT NULL) THEN max(try_cast({v} AS double)) END AS numeric_max,
  bool_and(coalesce(try_cast({v} AS double) = floor(try_cast({v} AS double)), false))::int AS all_integer,
  CASE WHEN bool_and(coalesce(try_cast({v} AS double) = floor(try_cast({v} AS double)), false)) THEN CASE WHEN min(try_cast({v} AS double)) >= 0 AND max(try_cast({v} AS double)) <= 10000 AND count(*) BETWEEN 20 AND 99999 THEN 'SMALLINT' ELSE 'INT' END WHEN bool_and(try_cast({v} AS double) IS NOT NULL) THEN 'NUMERIC' ELSE 'TEXT' END AS inferred_type FROM customer"""


_FEAT = FEATURES[FEATURES.index("feat AS (") + len("feat AS ") : FEATURES.index(",\ns AS")]
_NOISY = f"WITH noisy AS ({NOISY_SQL})"
_MONTHS = "WITH m AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL)"
_FLAGGED = "tbl IN ('celulares_2024', 'dados_criminais_2024', 'veiculos_2024')"
_KEEP = "(rest.num_bo IS NOT NULL OR (new.num_bo IS NOT NULL AND split_part(new.source_tables, '|', 1) < string_split(old.source_tables, '|')[-1]))"
_SAME = "old.num_bo = {0}.num_bo AND old.ano_bo = {0}.ano_bo AND old.delegacia = {0}.delegacia AND old.location_hash = {0}.location_hash"
_FILE_KINDS = "['Dados Crimináis', 'METODOLOGIA', 'dicionário de dados', 'Veículos Recuperados', 'Tabela de Campos']"
_LOOSE = "CASE WHEN regexp_matches({0}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN {0}::double END"
_TYPED = r"""CASE WHEN {d} IS NOT NULL THEN 'DATE' WHEN regexp_matches(t, '^([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9])?$') THEN 'TIME' WHEN {s} THEN 'TIMESTAMP' WHEN regexp_matches(t, '^-?[0-9]{1,18}$') THEN CASE WHEN t::bigint BETWEEN 0 AND 9999 THEN 'SMALLINT' WHEN t::bigint BETWEEN -2147483648 AND 2147483647 THEN 'INT' ELSE 'BIGINT' END WHEN regexp_matches(t, '^-?[0-9]+[.,][0-9]+$') THEN 'FLOAT' ELSE 'TEXT' END"""
_STAMP = "coalesce(regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[ T]([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$') AND try_strptime(regexp_extract({0}, '^([0-9-]+)', 1), '%Y-%m-%d') IS NOT NULL, false)"


def _floats(name: str, every: int, absent: str, low: str, high: str, numeric: int, whole: int) -> str:
    return f"SELECT '{name}' AS \"column\", count(*) FILTER ({absent}) AS null_count, count(*) AS total_count, ({low})::double AS numeric_min, ({high})::double AS numeric_max, {numeric} AS all_numeric, {whole} AS all_integer FROM events"


ORACLE_SQL = {
    "o1_1_csv_round_trip": f"{_NOISY} SELECT id::varchar AS id, v || CASE WHEN id % 3 = 0 THEN ';\"x\"' || chr(10) || 'y' ELSE '' END AS v FROM noisy",
    "o1_1_csv_in_splits": f"{_NOISY} SELECT id::varchar AS id, v || CASE WHEN id % 3 = 0 THEN ';\"x\"' || chr(10) || 'y' ELSE '' END AS v FROM noisy",
    "o1_3_parquet_text": f"{_NOISY} SELECT id::varchar AS id, {_T} AS v FROM noisy",
    "o1_5_merge": "SELECT o_orderstatus, count(*) + count(*) FILTER (o_orderstatus = 'F') AS rows FROM orders GROUP BY o_orderstatus",
    "o1_6_sample_rows": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5",
    "o1_7_select_files": f"WITH f AS (SELECT {_FILE_KINDS}[c_custkey % 5 + 1] || '_' || c_mktsegment || '_' || c_custkey AS name FROM customer), k AS (SELECT name, replace({_KEYED.format('name')}, ' ', '_') AS k FROM f) SELECT name, (NOT regexp_matches(k, 'METODOLOGIA|DICIONARIO|CAMPOS|TABELA'))::int AS is_data FROM k WHERE regexp_matches(k, 'VEICULOS_RECUPERADOS|BUILDING|DICIONARIO')",
    "o1_9_evolve_table": "SELECT c_custkey::varchar AS c_custkey, c_name, NULL::varchar AS segment FROM customer UNION ALL SELECT c_custkey::varchar, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 0",
    "o1_10_stable_ids": "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders",
    "o1_11_replace_month": "SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, CASE WHEN month >= '07' AND count(*) FILTER (o_orderkey % 2 = 0) > 0 THEN count(*) FILTER (o_orderkey % 2 = 0) ELSE count(*) END AS rows FROM orders GROUP BY 1, 2",
    "o1_12_coroner_export": "SELECT 'du-' || event_id AS NUM_BO, CASE WHEN event_id % 4 = 0 THEN '' ELSE lpad((event_id % 28 + 1)::varchar, 2, '0') || '/01/2024' END AS DATA_ENTRADA_IML, 'causa ' || event_id % 5 AS CAUSA_MORTIS, '2024' AS ANO_REFERENCIA, '01' AS MES_REFERENCIA, 'DU ' || event_id AS NUM_BO_NORMALIZED, '01 D P MAUA ' || event_id % 3 AS DELEGACIA_REGISTRO_NORMALIZED FROM events WHERE event_id % 10 <> 0",
    "o1_13_hash_files": "SELECT sha256(string_agg(o_orderkey || chr(10), '' ORDER BY o_orderkey)) AS sha256, sum(length(o_orderkey::varchar) + 1)::bigint AS size FROM orders GROUP BY o_orderpriority",
    "o2_2_names_of_the_api": f"{_NOISY} SELECT id::varchar AS \"ID\", v AS \"COLUNA_ESPECIAL\", upper(v) AS \"ACAO_FIM\", 'x' || v AS \"X_Y\" FROM noisy",
    "o2_3_duplicates_that_differ": f"{_NOISY} SELECT id::varchar AS \"ID\", v AS \"VALOR\", upper(v) AS \"VALOR_2\", 'x' || v AS \"X\" FROM noisy",
    "o2_4_fix_names": f"{_NOISY} SELECT id::varchar AS id, v AS column_2, upper(v) AS \"V\", 'x' || v AS v_2 FROM noisy",
    "o2_5_map_columns": f"{_NOISY} SELECT id::varchar AS \"ID\", v AS \"HORA_FATO\", upper(v) AS descricao FROM noisy",
    "o2_6_type_overrides": f"""{_NOISY}, c1 AS (SELECT id, v, {_T} AS t FROM noisy), m AS (SELECT *, {_numeric()} AS n FROM c1), c2 AS (SELECT id, upper(v) AS v, upper({_T}) AS t FROM noisy), a AS (SELECT id, {_NUMERIC} AS q, {_T.replace("(v,", "('x' || v,")} AS x FROM m),
b AS (SELECT id, CASE WHEN {_DESCRIPTIVE} THEN {_GENERAL} ELSE {_CLEAN_TIME} END AS h FROM c2) SELECT id::varchar AS "ID", q AS "QTDE_GRAMAS", h AS "HORA_FATO", x AS "X" FROM a JOIN b USING (id)""",
    "o3_8_dates_and_times": _cells(", ".join((f"(({_dated('t', _FORMS)}) IS NOT NULL)::int AS is_date", _is("regexp_matches(v, '^([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9])?$')", "is_time"), f"({_STAMP.format('v')})::int AS is_timestamp"))),
    "o3_13_checked_filter": _counted(f"{_DATES} AND {_CATS} AND {_HOURS} AND {_PERS}"),
    "o4_3_excel_serials": _cells(f"CASE WHEN id - 3 >= 1 THEN strftime(date '1899-12-31' + (id - 3 - (id - 3 > 59)::int)::int, '%Y-%m-%d') END AS d, CASE WHEN ({_dated('t', _FORMS)}) IS NOT NULL THEN t WHEN try_cast(regexp_extract(t, '^([0-9]{{1,9}})', 1) AS int) BETWEEN 30000 AND 73050 THEN strftime(date '1899-12-30' + regexp_extract(t, '^([0-9]{{1,9}})', 1)::int, '%Y-%m-%d') ELSE v END AS legacy"),
    "o4_6_excel_cells": f"{_NOISY}, n AS (SELECT id, id // 32 AS w, (id % 32) * 2700 AS s FROM noisy) SELECT id, CASE WHEN w >= 1 THEN strftime(date '1899-12-31' + (w - (w > 59)::int)::int, '%Y-%m-%d') END AS as_date, {_CLOCK.format('s')} AS as_time, (id / 32)::varchar AS as_text FROM n",
    "o4_16_flags_and_record_numbers": f"""{_NOISY}, m AS (SELECT id, v, {_T} AS t, {_SEPARATED.replace("(v,", "('+' || v,")} AS a, {_SEPARATED.replace("(v,", "(v || 'e2',")} AS b FROM noisy) SELECT id, {_LOOSE.format('a')} AS signed, {_LOOSE.format('b')} AS scaled, CASE WHEN upper(t) IN ('S', 'SIM', 'TRUE', '1') THEN 1 WHEN upper(t) IN ('N', 'NAO', 'NÃO', 'FALSE', '0') THEN 0 END AS flag, nullif(t, '') AS text FROM m""",
    "o4_28_value_type": _cells(_TYPED.replace("{d}", f"({_dated('t', _FORMS)})").replace("{s}", _STAMP.format("t")) + " AS value_type, CASE WHEN id <= 9999 THEN 'SMALLINT' ELSE 'INT' END AS id_type"),
    "o5_2_unique_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", least(count(DISTINCT {c}), 1000) AS unique_count FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    "o5_3_float_grammar": " UNION ALL ".join((_floats("floats", 6, "event_id % 6 = 5", "-7", "max(CASE WHEN event_id % 6 = 0 THEN event_id % 90 * 10 END)", 1, 0), _floats("whole", 3, "event_id % 3 = 2", "2", "1000", 1, 1), _floats("suffixed", 2, "false", "NULL", "NULL", 0, 0), _floats("grouped", 2, "false", "NULL", "NULL", 0, 0))),
    "o6_6_other_records": f"""{_ALL}, k AS (SELECT *, id - 1 AS e, kind + 1 AS j FROM first_) SELECT id, ['produtividade_armas_2024', 'produtividade_veiculos_recuperados_2024', 'produtividade_presos_2024'][j] AS source_table, ['Apreensão de Armas', 'Veículos Recuperados', 'Presos'][j] AS category, ['PORTE ILEGAL DE ARMA DE FOGO DE USO PERMITIDO', 'RECUPERAÇÃO DE VEÍCULO', 'PRISÃO EM FLAGRANTE'][j] AS rubrica_for_styling,
  ['produtividade_armas', 'produtividade_veiculos', 'produtividade_pessoa'][j] AS type, CASE WHEN kind = 0 THEN nullif(DESC_ARMA_FOGO, '') END AS tipo_arma, CASE WHEN kind = 0 THEN CALIBRE END AS calibre, CASE kind WHEN 0 THEN trim(ARMA_NOME_MARCA) WHEN 1 THEN nullif(DESCR_MARCA_VEICULO, '') END AS marca, CASE WHEN kind = 1 THEN PLACA_VEICULO END AS placa, CASE WHEN kind = 1 THEN DESCR_TIPO_VEICULO END AS tipo_veiculo,
  CASE WHEN kind = 1 THEN ANO_MODELO::bigint END AS ano_modelo, CASE WHEN kind = 2 THEN CASE e % 5 WHEN 0 THEN 31 WHEN 1 THEN 20 WHEN 2 THEN 47 WHEN 4 THEN 18 END END::bigint AS idade, CASE WHEN kind = 2 THEN coalesce(nullif(trim(COR_CUTIS), ''), 'Curtis') END AS cor, NATUREZA_APURADA AS natureza_apurada, CASE e % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS flagrante, reg AS data_registro FROM k""",
    "o6_14_refresh_known_tables": f"""{_ALL}, old AS (SELECT * FROM feat), new AS {_FEAT.replace('WHICH', f'{_FLAGGED} AND substring(num_bo, 3, 6)::int % 2 = 0')}, rest AS {_FEAT.replace('WHICH', f'NOT {_FLAGGED}')}, j AS (SELECT old.num_bo, old.ano_bo, old.delegacia, old.location_hash, {_KEEP} AS keep, old, new, rest FROM old LEFT JOIN new ON {_SAME.format('new')} LEFT JOIN rest ON {_SAME.format('rest')} WHERE new.num_bo IS NOT NULL OR rest.num_bo IS NOT NULL)
SELECT num_bo, ano_bo, delegacia, location_hash, round(CASE WHEN keep THEN old.latitude ELSE new.latitude END, 6) AS latitude, round(CASE WHEN keep THEN old.longitude ELSE new.longitude END, 6) AS longitude, coalesce(new.category, old.category) AS category, coalesce(new.sty, old.sty) AS rubrica_for_styling, strftime(coalesce(new.d, CASE WHEN keep THEN old.d END), '%Y-%m-%d') AS data_ocorrencia,
  array_to_string(list_sort(string_split(concat_ws('|', rest.source_tables, new.source_tables), '|')), '|') AS source_tables, array_to_string(list_sort(list_distinct(list_concat(coalesce(rest.rubs, []), coalesce(new.rubs, [])))), '|') AS all_rubricas, (coalesce(rest.n, 0) + coalesce(new.n, 0))::int AS total_records, coalesce(new.n_cel, 0)::int AS celulares_count, coalesce(rest.n_prod, 0)::int AS produtividade_count, concat_ws('|', rest.records, new.records) AS records,
  coalesce(new.tl, CASE WHEN keep THEN old.tl END) AS tipo_local, coalesce(new.per, CASE WHEN keep THEN old.per END) AS periodo FROM j""",
    "o8_6_count_features": f"{_ALL} SELECT count(*) AS count FROM s WHERE {_DATES} AND {_CATS} AND {_HOURS} AND {_PERS}",
    "o8_18_weapon_chart": f"{_ALL}, w AS (SELECT coalesce(nullif(DESC_ARMA_FOGO, ''), CALIBRE) AS label, count(*) AS count FROM rows_ WHERE kind = 0 GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY count DESC, label)::int AS rank, * FROM w) SELECT * FROM k WHERE rank <= 12",
    "o8_21_merge_arrays": f"{_ALL} SELECT num_bo, location_hash, delegacia, array_to_string(list_sort(list_distinct(list_concat(rubs, string_split(source_tables, '|'), [category]))), '|') AS merged FROM s",
    "o9_3_report_at_a_unit": f"{_ALL} SELECT num_bo, delegacia, location_hash, category, n::int AS total_records FROM s WHERE num_bo = 'DU000009' AND ano_bo = 2024 AND delegacia = 'DP 2' OR num_bo = 'DU000007' AND ano_bo = 2024 AND delegacia = ''",
    "o9_4_report_summaries": f"{_ALL} SELECT num_bo, ano_bo, location_hash, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, category, sty AS rubrica_for_styling, strftime(d, '%Y-%m-%d') AS data_ocorrencia, source_tables FROM s WHERE num_bo = 'DU000009'",
    "o9_5_feature_detail": f"WITH every AS ({_CORONER}), {_ALL.removeprefix('WITH ')} SELECT s.num_bo, s.delegacia, s.location_hash, n::int AS total_records, coroner_ids FROM s JOIN every USING (num_bo, delegacia, location_hash) WHERE num_bo = 'DU000009' AND ano_bo = 2024 ORDER BY d DESC NULLS FIRST, s.delegacia, s.location_hash LIMIT 1",
    "o9_7_tile_metadata": f"""{_ALL}, c AS (SELECT unnest({_BUCKETS}) AS name, count(*) AS k FROM s GROUP BY 1), p AS (SELECT p AS name, count(*) AS k FROM s WHERE p IS NOT NULL GROUP BY 1)
SELECT strftime(min(d), '%Y-%m-%d') AS min_date, strftime(max(d), '%Y-%m-%d') AS max_date, strftime(greatest(min(d), (max(d) - interval 3 month)::date), '%Y-%m-%d') AS default_after, count(*) AS count, (SELECT string_agg(name || ':' || k, '|' ORDER BY name) FROM c) AS categories, (SELECT string_agg(name || ':' || k, '|' ORDER BY name) FROM p) AS periods FROM s""",
    "o11_8_file_groups": "SELECT 'f' || o_custkey % 40 AS url, max(year(o_orderdate))::int AS year, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS categories FROM orders GROUP BY 1",
    "o11_9_stale_files": "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR o_orderdate < timestamp '1998-01-01' - interval 400 day",
    "o11_10_coroner_month_decisions": f"{_MONTHS} SELECT year::int AS year, month::int AS month, CASE WHEN month = 3 THEN 'error' WHEN month NOT IN (5, 7) AND year % 2 = 0 THEN 'unchanged' ELSE 'replace' END AS action FROM m WHERE month < 11",
    "o11_11_file_metadata": f"{_MONTHS} SELECT year::int AS year, month::int AS month, CASE WHEN month >= 6 THEN 'new' || n ELSE 'old' END AS file_hash, CASE WHEN month >= 6 THEN 1 ELSE n END AS n FROM m",
    "o11_12_flagged_tables": f"{_ALL} SELECT DISTINCT tbl AS source_table, (tbl = 'celulares_2024')::int AS needs_geom_update FROM rows_",
    "o3_predicates": _cells(", ".join((_is("regexp_matches(v, '(?i)^(null)+$')", "is_null"), _is(r"regexp_matches(lower(v), '^n[ãa]o\s+informado$')", "not_informed"), _is("regexp_matches(v, '^#+$')", "overflow"), _is("regexp_matches(v, '^[0-9]{5}-[0-9]{3}$')", "zip"), _is("regexp_matches(v, '^[0-9]+(-[0-9]+)+$')", "dashed"),
                                      _is("regexp_matches(v, '^-?[0-9]+$')", "is_integer"), _is(r"regexp_matches(v, '^-?[0-9]*\.?[0-9]*$') AND v NOT IN ('', '-', '.')", "is_numeric"), _is(_VERBATIM.replace("(t,", "(v,"), "is_time"), _is(_DESCRIPTIVE, "descriptive")))),
    "o4_1_parse_date": _cells(f"strftime({_dated('t', _FORMS)}, '%Y-%m-%d') AS d, {_ISO13} AS iso, coalesce({_ISO13}, strftime({_SERIAL}, '%Y-%m-%d'), v) AS serial"),
    "o4_7_parse_time": _cells(f"{_TIME} AS t"),
    "o4_8_clean_date": _cells(f"{_CLEAN_DATE} AS cleaned"),
    "o4_9_clean_time": _cells(f"{_CLEAN_TIME} AS cleaned"),
    "o4_10_clean_numeric": f"WITH noisy AS ({NOISY_SQL}), cells AS (SELECT id, v, {_T} AS t FROM noisy), m AS (SELECT *, {_numeric()} AS n FROM cells) SELECT id, {_NUMERIC} AS cleaned FROM m",
    "o4_11_clean_integer": _cells(f"{_INTEGER} AS cleaned"),
    "o4_12_clean_general": _cells(f"{_GENERAL} AS cleaned, nullif(trim(v), '') AS source_text"),
    "o4_14_parse_source_number": f"WITH noisy AS ({NOISY_SQL}), m AS (SELECT id, v, {_SEPARATED} AS s FROM noisy) SELECT id, {_NUMBER} AS number, trunc({_NUMBER})::bigint AS whole, (upper(trim(v)) IN ('S', 'SIM', 'TRUE', '1'))::int AS is_yes, (upper(trim(v)) IN ('N', 'NAO', 'NÃO', 'FALSE', '0'))::int AS is_no FROM m",
    "o4_17_parse_source_date": _cells(f"strftime(coalesce({_dated('t', (('^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:$|[ T])', '%Y-%m-%d'), ('^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', '%d/%m/%Y'), ('^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$', '%d-%m-%Y')))}, {_SERIAL}), '%Y-%m-%d') AS d"),
    "o4_19_normalize_period": _cells(f"{_period('v')} AS period, {_label(_period('v'))} AS label, {_sort(_period('v'))} AS sort"),
    "o4_21_occurrence_hour": _cells(r"try_cast(nullif(regexp_extract(v, '^\s*(2[0-3]|[01]?[0-9])(?:$|[^0-9])', 1), '') AS int) AS hour"),
    "o4_24_lookup_key": _cells(rf"{_KEYED.format('v')} AS lookup_key, replace(lower(strip_accents(v)), ' ', '_') AS normalized_text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(strip_accents(t)), '\s+', '_', 'g'), '[^A-Z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS column_name"),
    "o4_26_quantities": _cells(r"CASE WHEN regexp_matches(v, '^[0-9]{1,9}$') THEN v::bigint ELSE 1 END AS quantity, CASE WHEN regexp_matches(v, '^[0-9]+([.,][0-9]+)?$') THEN replace(v, ',', '.')::double ELSE 0 END AS grams"),
    "o1_text_form": f"WITH noisy AS ({NOISY_SQL}), m AS (SELECT CASE WHEN id % 3 > 0 THEN id::varchar END AS a, CASE WHEN upper(trim(v)) = 'NULL' THEN NULL ELSE nullif(trim(v), '') END AS b FROM noisy) SELECT a, CASE WHEN regexp_matches(b, '^[=+@-]') THEN '''' || b ELSE b END AS b FROM m WHERE a IS NOT NULL OR b IS NOT NULL",
    "o1_8_union_tables": f"WITH raw AS ({RAW_SQL}) SELECT CASE src WHEN 0 THEN 'celulares_2023' ELSE 'celulares_2024' END AS source_table, count(*) AS rows, count(*) FILTER (src = 0) AS with_city, count(*) FILTER (src = 2) AS with_town FROM raw WHERE src IN (0, 2) GROUP BY 1",
    "o5_1_profile_columns": " UNION ALL ".join(map(_profile, ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))),
    "o5_6_prepare_table": f"""WITH noisy AS ({NOISY_SQL}), cells AS (SELECT id, v, {_T} AS t FROM noisy), m AS (SELECT *, {_numeric()} AS n FROM cells) SELECT id::varchar AS "ID", CASE WHEN {_DESCRIPTIVE} THEN {_GENERAL} ELSE {_CLEAN_TIME} END AS "HORA_FATO", {_NUMERIC} AS "QTDE_GRAMAS" FROM m""",
    "o6_9_group_features": f"{_ALL} SELECT num_bo, ano AS ano_bo, dl AS delegacia, location_hash, tbl AS source_table, max(cat) FILTER (f) AS category, strftime(max(d) FILTER (f), '%Y-%m-%d') AS data_ocorrencia, count(*) AS n_records, coalesce(string_agg(DISTINCT rub, '|' ORDER BY rub), '') AS all_rubricas FROM first_ GROUP BY num_bo, ano, dl, location_hash, tbl",
    "o6_11_merge_features": f"{_ALL} {_FLAT}",
    "o6_12_remove_source_table": f"""{_ALL}, r AS (SELECT num_bo, ano, dl, location_hash, count(*) AS n2, count(*) FILTER (rtype = 'celular') AS c2, count(*) FILTER (rtype LIKE 'produtividade%') AS p2, string_agg(DISTINCT tbl, '|' ORDER BY tbl) AS t2, coalesce(string_agg(DISTINCT rub, '|' ORDER BY rub), '') AS b2, string_agg(tbl || ':' || id, '|' ORDER BY tbl, id) AS r2 FROM first_ WHERE tbl <> 'objetos_2024' GROUP BY num_bo, ano, dl, location_hash)
SELECT feat.num_bo, ano_bo, delegacia, feat.location_hash, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, category, sty AS rubrica_for_styling, strftime(d, '%Y-%m-%d') AS data_ocorrencia, t2 AS source_tables, b2 AS all_rubricas, n2::int AS total_records, c2::int AS celulares_count, p2::int AS produtividade_count, r2 AS records, tl AS tipo_local, per AS periodo FROM feat JOIN r ON feat.num_bo = r.num_bo AND ano_bo = ano AND delegacia = dl AND feat.location_hash = r.location_hash""",
    "o6_13_upsert_features": f"{_ALL} {_FLAT}",
    "o6_15_search_columns": f"{_ALL} SELECT num_bo, location_hash, delegacia, p AS periodo_normalized, h AS hora_ocorrencia, n::int AS total_records, array_to_string(cats, '|') AS search_categories, round(x, 2) AS x, round(y, 2) AS y FROM s",
    "o6_17_date_range": "WITH o AS (SELECT (o_orderdate::date + interval 240 month)::date AS d FROM orders) SELECT strftime(min(d), '%Y-%m-%d') AS min_date, strftime(max(d), '%Y-%m-%d') AS max_date, strftime(greatest(min(d), (max(d) - interval 3 month)::date), '%Y-%m-%d') AS default_after FROM o WHERE d >= date '2013-01-01'",
    "o6_18_etl_status": f"{_ALL} SELECT tbl AS source_table, 'completed' AS status, count(*) AS rows_processed FROM rows_ GROUP BY tbl UNION ALL SELECT 'dados_criminais_2013', 'pending', 0",
    "o6_19_hydrate_records": f"""{_ALL}, v AS (SELECT num_bo, ano, dl, latb, lonb, count(*) AS k FROM rows_ WHERE src = 1 GROUP BY ALL)
SELECT feat.num_bo, delegacia, location_hash, (n - n_vei + coalesce(k, 0))::int AS total_records, coalesce(k, 0)::int AS veiculos_count FROM feat LEFT JOIN v ON feat.num_bo = v.num_bo AND ano_bo = ano AND delegacia = dl AND latb = round(latitude::decimal(20, 10), 4) AND lonb = round(longitude::decimal(20, 10), 4) AND n_vei > 0""",
    "o7_1_dates": _counted(_DATES),
    "o7_2_categories": _counted("list_has_any(cats, ['Furto - click', 'Furto - view'])"),
    "o7_3_periods": _counted(_PERS),
    "o7_4_hours": _counted("h >= 22 OR h <= 5"),
    "o7_5_bounds": _counted("longitude BETWEEN -46.2 AND -46.1 AND latitude BETWEEN -23.2 AND -23.1"),
    "o7_6_radius": _counted(_NEAR),
    "o7_7_tile_filter": _counted("d >= date '2024-01-05' AND list_contains(cats, 'Furto - click')"),
    "o8_2_category_stats": _categories(f"{_DATES} AND {_PERS} AND {_HOURS}"),
    "o8_3_category_stats_for_location": _categories(_NEAR),
    "o8_4_period_stats": f"{_ALL} SELECT p AS period, {_label('p')} AS label, count(*) AS count FROM s WHERE {_DATES} AND {_CATS} AND {_HOURS} AND p IS NOT NULL GROUP BY p",
    "o8_5_category_period_stats": f"{_ALL}, b AS (SELECT 'category' AS kind, unnest({_BUCKETS}) AS name FROM s WHERE {_DATES} AND {_CATS} AND {_HOURS} AND {_PERS} UNION ALL SELECT 'period', p FROM s WHERE {_DATES} AND {_CATS} AND {_HOURS} AND p IS NOT NULL) SELECT kind, name, count(*) AS count FROM b GROUP BY kind, name",
    "o8_7_totals": f"{_ALL} SELECT count(*) AS total_features, coalesce(sum(n), 0)::bigint AS total_records FROM s WHERE {_DATES} AND {_CATS} AND {_HOURS} AND {_PERS}",
    "o8_20_all_charts": _CHARTS,
    "o9_1_coroner_join": _CORONER,
    "o9_3_by_report": f"{_ALL} SELECT num_bo, ano_bo, location_hash, category, strftime(d, '%Y-%m-%d') AS data_ocorrencia, n::int AS total_records FROM s WHERE num_bo IN (SELECT 'DU' || lpad(c_custkey::varchar, 6, '0') FROM customer)",
    "o9_6_grouped_occurrences": f"""{_ALL} SELECT tbl || ':' || id AS occurrence_id, tbl AS source_table, r.num_bo, ano_bo, r.location_hash, coalesce(rub, category) AS category, sty AS rubrica_for_styling, feat.reg AS data_registro, feat.hr AS hora_ocorrencia, NULL::varchar AS logradouro, NULL::varchar AS numero_logradouro, NULL::varchar AS bairro, feat.cidade, feat.tl AS local_tipo,
  feat.per AS periodo, cond AS conduta, nat AS natureza_apurada, ['Celulares', 'Veículos', 'Objetos', 'Dados criminais', 'Entorpecentes'][src + 1] AS record_label, category AS primary_category, n::int AS record_count, delegacia, strftime(feat.d, '%Y-%m-%d') AS data_ocorrencia, round(feat.latitude, 6) AS latitude, round(feat.longitude, 6) AS longitude, CASE WHEN len(rubs) > 0 THEN array_to_string(rubs, '|') ELSE category END AS all_categories, source_tables
FROM rows_ r JOIN feat ON r.num_bo = feat.num_bo AND ano = ano_bo AND dl = delegacia AND r.location_hash = feat.location_hash""",
    "o10_4_cluster_pyramid": _PYRAMID,
    "o10_5_raw_points": _POINTS,
    "o11_2_import_statistics": f"{_CATALOG} SELECT count(DISTINCT category) AS total_categories, count(DISTINCT category) FILTER (rows > 0) AS categories_with_data, count(*) AS total_tables, count(*) FILTER (rows > 0) AS tables_with_data, coalesce(sum(rows), 0)::bigint AS total_records FROM st",
    "o11_3_tables_needing_attention": f"{_CATALOG} SELECT category, year, CASE WHEN there THEN 'empty' ELSE 'missing' END AS problem FROM st WHERE rows = 0",
    "o11_4_import_decisions": f"""{_CATALOG}, j AS (SELECT st.*, old.h AS oh, new.h AS nh FROM st LEFT JOIN old USING (category, year) LEFT JOIN new USING (category, year)), w AS (SELECT category, year, CASE WHEN NOT there THEN 'missing' WHEN rows = 0 THEN 'empty' WHEN year > 2026 THEN 'future' WHEN year < 2026 THEN 'past' WHEN nh IS NULL THEN 'unavailable' WHEN oh IS DISTINCT FROM nh THEN 'changed' ELSE 'unchanged' END AS reason FROM j)
SELECT category, year, (reason IN ('missing', 'empty', 'changed'))::int AS import, reason FROM w""",
    "o11_5_changed_files": f"{_CATALOG} SELECT new.category, new.year, new.h AS file_hash FROM new LEFT JOIN old USING (category, year) WHERE old.h IS DISTINCT FROM new.h",
    "o11_6_coroner_month_targets": """WITH have AS (SELECT DISTINCT year(ts) AS year, month(ts) AS month FROM events UNION SELECT DISTINCT year(o_orderdate) + 20, month(o_orderdate) FROM orders), m AS (SELECT unnest(generate_series(timestamp '2013-01-01', timestamp '2024-02-01', interval 1 month)) AS day0)
SELECT year(day0)::int AS year, month(day0)::int AS month, CASE WHEN have.year IS NULL THEN 'no data' WHEN month(day0) = 5 THEN 'no file' ELSE 'recent' END AS reason FROM m LEFT JOIN have ON year(day0) = have.year AND month(day0) = have.month WHERE have.year IS NULL OR month(day0) = 5 OR day0 > timestamp '2023-11-01'""",
}
#: Queries that read a store have the answers of those that read the features themselves.
ORACLE_SQL |= {"o6_14_stored_refresh": ORACLE_SQL["o6_14_refresh_known_tables"], "o9_3_stored_reports": ORACLE_SQL["o9_3_by_report"], "o9_5_stored_detail": ORACLE_SQL["o9_5_feature_detail"],
               "o5_1_merged_profile": ORACLE_SQL["o5_1_profile_columns"], "o7_2_indexed_categories": ORACLE_SQL["o7_2_categories"]}
_SIDE = f"({_W} / 16384)"
ORACLE_SQL |= {
    "o10_1_stored_tile_points": f"""{_ALL} SELECT num_bo, delegacia, location_hash, category, n::int AS total_records, round(x, 2) AS x, round(y, 2) AS y FROM s
WHERE x BETWEEN 6080 * {_SIDE} - {_W} / 2 AND 6120 * {_SIDE} - {_W} / 2 AND y BETWEEN {_W} / 2 - 9310 * {_SIDE} AND {_W} / 2 - 9270 * {_SIDE} AND year(d) = 2024""",
    "o10_5_capped_points": f"""{_ALL}, q AS (SELECT *, floor((floor(x / 5000) * 5000 + {_W} / 2) / ({_W} / 65536))::bigint AS tile_x, floor(({_W} / 2 - floor(y / 5000) * 5000) / ({_W} / 65536))::bigint AS tile_y FROM s)
SELECT num_bo, location_hash, delegacia, tile_x, tile_y FROM q QUALIFY row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY num_bo, ano_bo, nullif(delegacia, '') NULLS FIRST, location_hash) <= 2""",
}
