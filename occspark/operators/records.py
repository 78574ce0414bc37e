"""The source tables' configurations and what is taken from a raw row (O-6.1 to O-6.8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions import values as V

KEY = ["num_bo", "ano_bo", "delegacia", "location_hash"]


@dataclass(frozen=True)
class SourceConfig:
    """How rows of tables with a name prefix are read. fields: record field -> (kind, columns by preference)."""

    pattern: str
    record_type: str
    fields: dict[str, tuple[str, ...]]
    rubric: str | None = "RUBRICA"
    category: str | None = None
    styling: str | None = None


# Columns, types and categories of the source tables.
_OBJECT = {"descr_modo_objeto": ("text", "DESCR_MODO_OBJETO"), "descr_tipo_objeto": ("text", "DESCR_TIPO_OBJETO"), "descr_subtipo_objeto": ("text", "DESCR_SUBTIPO_OBJETO"), "marca": ("text", "MARCA_OBJETO"), "quantidade": ("int", "QUANTIDADE_OBJETO")}
_VEHICLE = {"descr_ocorrencia": ("text", "DESCR_OCORRENCIA_VEICULO"), "tipo_veiculo": ("text", "DESCR_TIPO_VEICULO"), "marca": ("text", "DESCR_MARCA_VEICULO"), "cor": ("text", "DESC_COR_VEICULO"), "placa": ("text", "PLACA_VEICULO"), "ano_fabricacao": ("int", "ANO_FABRICACAO"), "ano_modelo": ("int", "ANO_MODELO")}
_SHOWN = {"descricao_apresentacao": ("text", "DESCRICAO_APRESENTACAO"), "natureza_apurada": ("text", "NATUREZA_APURADA")}
_PERSON = _SHOWN | {"tipo_pessoa": ("text", "DESCR_TIPO_PESSOA"), "sexo": ("text", "SEXO_PESSOA"), "idade": ("int", "IDADE_PESSOA"), "cor": ("text", "COR_CUTIS", "COR_CURTIS"), "profissao": ("text", "DESCR_PROFISSAO"), "grau_instrucao": ("text", "DESCR_GRAU_INSTRUCAO"), "nacionalidade": ("text", "NACIONALIDADE_PESSOA")}
CONFIGS = (
    SourceConfig("produtividade_armas", "produtividade_armas", _SHOWN | {"descr_modo_objeto": ("text", "DESC_OBJETO_MODO"), "tipo_arma": ("text", "DESC_ARMA_FOGO"), "marca": ("text", "ARMA_NOME_MARCA"), "calibre": ("text", "CALIBRE")}, None, "Apreensão de Armas", "PORTE ILEGAL DE ARMA DE FOGO DE USO PERMITIDO"),
    SourceConfig("produtividade_entorpecentes", "produtividade_entorpecentes", _SHOWN | {"tipo_droga": ("text", "DESCR_TOXICO"), "quantidade_gramas": ("number", "QTDE_GRAMAS_ARRED")}, None, "Apreensão de Entorpecentes", "TRÁFICO DE DROGAS"),
    SourceConfig("produtividade_veiculos_recuperados", "produtividade_veiculos", _SHOWN | _VEHICLE, None, "Veículos Recuperados", "RECUPERAÇÃO DE VEÍCULO"),
    SourceConfig("produtividade_presos", "produtividade_pessoa", _PERSON, None, "Presos", "PRISÃO EM FLAGRANTE"),
    SourceConfig("produtividade_prisoes_efetuadas", "produtividade_pessoa", _PERSON, None, "Prisões Efetuadas", "PRISÃO EM FLAGRANTE"),
    SourceConfig("produtividade_flagrantes_lavrados", "produtividade_pessoa", _PERSON, None, "Flagrantes Lavrados", "PRISÃO EM FLAGRANTE"),
    SourceConfig("produtividade_137_eca", "produtividade_pessoa", _PERSON, None, "ECA Art. 137", "ATO INFRACIONAL"),
    SourceConfig("celulares", "celular", _OBJECT | {"bloqueio": ("flag", "FLAG_BLOQUEIO"), "desbloqueio": ("flag", "FLAG_DESBLOQUEIO")}),
    SourceConfig("veiculos", "veiculo", _VEHICLE),
    SourceConfig("objetos", "objeto", _OBJECT),
    SourceConfig("dados_criminais", "dados_criminais", {"natureza_apurada": ("text", "NATUREZA_APURADA"), "conduta": ("text", "DESCR_CONDUTA")}),
)
LOCATION = {"logradouro": ["LOGRADOURO"], "numero": ["NUMERO_LOGRADOURO"], "bairro": ["BAIRRO"], "cidade": ["CIDADE", "NOME_MUNICIPIO"], "cep": ["CEP"], "tipo_local": ["DESCR_TIPOLOCAL"], "subtipo_local": ["DESCR_SUBTIPOLOCAL"]}
OCCURRENCE = {"hora_ocorrencia": ["HORA_OCORRENCIA", "HORA_OCORRENCIA_BO", "HORA_FATO"], "periodo": ["DESCR_PERIODO", "DESC_PERIODO"], "delegacia": ["NOME_DELEGACIA"], "delegacia_circunscricao": ["NOME_DELEGACIA_CIRC", "NOME_DELEGACIA_CIRCUNSCRICAO"], "departamento": ["NOME_DEPARTAMENTO"], "seccional": ["NOME_SECCIONAL"], "natureza_apurada": ["NATUREZA_APURADA"], "conduta": ["DESCR_CONDUTA"], "autoria": ["AUTORIA_BO"], "flagrante": ["FLAG_FLAGRANTE"], "data_registro": ["DATA_REGISTRO", "DATAHORA_REGISTRO_BO"], "data_comunicacao": ["DATA_COMUNICACAO_BO"]}
REQUIRED = ["id", "NUM_BO", "ANO_BO", "LATITUDE", "LONGITUDE", "DATA_OCORRENCIA_BO", "NOME_DELEGACIA"]
_TYPES = {"text": "string", "int": "bigint", "number": "double", "flag": "boolean"}
#: Every field that some record has: all records share one wide struct, so that a reader of one field prunes the rest.
RECORD_FIELDS = {"type": "string", "source_id": "bigint", "source_table": "string", "rubrica": "string"} | {f: _TYPES[k[0]] for c in CONFIGS for f, k in c.fields.items()}


def source_config(table: str) -> SourceConfig | None:
    """O-6.1: the first configuration whose pattern the table's name starts with."""
    return next((c for c in CONFIGS if table.startswith(c.pattern)), None)


def select_needed(df: DataFrame, config: SourceConfig) -> DataFrame:
    """O-6.2: the columns that are read later; a required one that is missing is an error."""
    missing = [c for c in [*REQUIRED, *([config.rubric] if config.rubric else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    wanted = {*REQUIRED, config.rubric, *(c for k in config.fields.values() for c in k[1:]), *(c for m in (LOCATION, OCCURRENCE) for own in m.values() for c in own)}
    return df.select(*[c for c in df.columns if c in wanted])


def filter_processable(df: DataFrame) -> DataFrame:
    """O-6.3: rows with a number, a year and coordinates inside the state."""
    # a distance from the middle (exact for these bounds) names the number once: it is neither read twice nor, as BETWEEN would have it, before the other conditions
    inside = " AND ".join(f"abs({V.number_sql(c)} - ({(low + high) / 2})) <= {(high - low) / 2}" for c, (low, high) in (("LATITUDE", P.BOX["lat"]), ("LONGITUDE", P.BOX["lon"])))
    return df.where(f"{X.text_sql('NUM_BO')} IS NOT NULL AND {V.number_sql('ANO_BO')} IS NOT NULL AND {inside}")


def _texts(df: DataFrame) -> dict[str, str]:
    """The trimmed text of each column, blank as NULL, as SQL."""
    return {c: X.text_sql(f"`{c}`") for c in df.columns}


def _first_sql(columns: tuple[str, ...], among: dict[str, str]) -> str:
    """The first of some columns that has text, as SQL. among: SQL of each column's text."""
    own = [among[c] for c in columns if c in among]
    return "cast(NULL AS string)" if not own else own[0] if len(own) == 1 else f"coalesce({', '.join(own)})"


def _struct_sql(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _location_sql(among: dict[str, str]) -> str:
    return _struct_sql({f: _first_sql(tuple(c), among) for f, c in LOCATION.items()})


def _occurrence_sql(among: dict[str, str]) -> str:
    iso = lambda x: f"trim(LEADING '+' FROM date_format({V.date_sql(x)}, 'yyyy-MM-dd'))"
    convert = {"flagrante": V.flag_sql, "data_registro": iso, "data_comunicacao": iso}
    return _struct_sql({f: convert.get(f, str)(_first_sql(tuple(c), among)) for f, c in OCCURRENCE.items()})


def _record_sql(config: SourceConfig, table: str, among: dict[str, str]) -> str:
    read = {"text": str, "flag": V.flag_sql, "int": lambda x: f"cast({V.number_sql(x, V.RECORD_NUMBER)} AS bigint)", "number": lambda x: V.number_sql(x, V.RECORD_NUMBER)}
    own = {"type": f"'{config.record_type}'", "source_id": "cast(id AS bigint)", "source_table": _quoted(table)}
    if config.rubric:
        own["rubrica"] = _first_sql((config.rubric,), among)
    for name, (kind, *columns) in config.fields.items():
        own[name] = read[kind](_first_sql(tuple(columns), among))
    return _struct_sql({f: f"cast({own[f]} AS {t})" if f in own else f"cast(NULL AS {t})" for f, t in RECORD_FIELDS.items()})


def _category_sql(config: SourceConfig, among: dict[str, str]) -> tuple[str, str]:
    rubric = _first_sql((config.rubric,), among) if config.rubric else "cast(NULL AS string)"
    return f"coalesce({rubric}, {_quoted(config.category or 'Outros')})", f"coalesce({rubric}, {_quoted(config.styling or 'default')})"


def _known_sql(date: str) -> str:
    return f"CASE WHEN {date} >= DATE'2013-01-01' THEN {date} END"


def extract_location(df: DataFrame) -> Column:
    """O-6.4: each field from its first column with text."""
    return F.expr(_location_sql(_texts(df)))


def extract_occurrence(df: DataFrame) -> Column:
    """O-6.5: like O-6.4, then converted; a first text that can't be read gives NULL, later columns aren't tried."""
    return F.expr(_occurrence_sql(_texts(df)))


def extract_record(df: DataFrame, config: SourceConfig, table: str) -> Column:
    """O-6.6: the row's record, in the struct that all types share."""
    return F.expr(_record_sql(config, table, _texts(df)))


def derive_category(df: DataFrame, config: SourceConfig) -> tuple[Column, Column]:
    """O-6.7: (category, styling): the rubric, else what the configuration says, else others."""
    category, styling = _category_sql(config, _texts(df))
    return F.expr(category), F.expr(styling)


def derive_date(c: str) -> Column:
    """O-6.8: the date of occurrence, from 2013 on."""
    return F.expr(_known_sql(V.date_sql(c)))


def source_rows(df: DataFrame, table: str) -> DataFrame:
    """Processable rows in the shape that grouping takes: key, place, category, date and record.

    Texts are trimmed and coordinates and the date read once, in one step that isn't fused with
    others (a fused method that long isn't compiled); the next makes the wide struct of them.
    """
    config = source_config(table)
    if config is None:
        raise ValueError(f"no configuration for {table}")
    rows = filter_processable(select_needed(df, config))
    among = {c: f"`{c}`" for c in rows.columns}
    told = {"_lat": V.number_sql("LATITUDE"), "_lon": V.number_sql("LONGITUDE"), "_date": V.date_sql("DATA_OCORRENCIA_BO")}
    read = rows.selectExpr("id", *[f"{sql} AS `{c}`" for c, sql in _texts(rows).items() if c != "id"], *[f"{sql} AS {c}" for c, sql in told.items()])
    category, styling = _category_sql(config, among)
    return read.selectExpr(
        "NUM_BO AS num_bo", f"cast({V.number_sql('ANO_BO')} AS int) AS ano_bo", "NOME_DELEGACIA AS delegacia", f"{V.hash_sql('_lat', '_lon')} AS location_hash", "_lat AS latitude", "_lon AS longitude",
        f"{category} AS category", f"{styling} AS rubrica_for_styling", f"{_known_sql('_date')} AS data_ocorrencia", f"{_location_sql(among)} AS location", f"{_occurrence_sql(among)} AS occurrence", f"{_record_sql(config, table, among)} AS record",
        f"{_quoted(table)} AS source_table", f"{V.bucket_sql('_lat')} AS lat_bucket", f"{V.bucket_sql('_lon')} AS lon_bucket", "cast(id AS bigint) AS id")
