"""Queries over single rows: scalar columns and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions import amounts, dates, status, text, urls
from atalaya.operators import changes, filters, normalize, pattern_index
from atalaya.plans.registry import query
from atalaya.plans.tables import AS_OF, cte, read, view

C = F.col
NOW = f"cast('{AS_OF}' as timestamp)"


def _duck_status(c: str) -> str:
    canonical = ", ".join(f"'{s}'" for s in fixed.LIVE_STATUSES + fixed.CLOSED_STATUSES + [fixed.UNKNOWN_STATUS])
    posts = " ".join(f"when lower(trim({c})) = '{k}' then '{v}'" for k, v in fixed.POST_STATUS.items())
    found = " ".join(f"when regexp_matches({c}, '{p}', 'i') then '{s}'" for p, s in fixed.STATUS_PATTERNS)
    return (
        f"case when {c} is null or trim({c}) = '' then 'DESCONOCIDO' "
        f"when upper(trim({c})) in ({canonical}) then upper(trim({c})) {posts} {found} else 'DESCONOCIDO' end"
    )


def duck_excluded(c: str) -> str:
    return f"regexp_matches({c}, '\\b(" + "|".join(fixed.EXCLUDED_TITLES) + ")\\b', 'i')"


DUCK_STATUS = _duck_status("estado")
# What the date texts of the item view say, by the form each line number has.
DUCK_DATE = "case when linea <= 5 then cierre end"
DUCK_EXCLUDED = duck_excluded("titulo")
DUCK_OLD_YEAR = (
    r"len(list_filter(regexp_extract_all(titulo, '\b(20[0-2]\d)\b', 1), "
    r"lambda y: cast(y as int) < {year})) > 0"
)


@query(
    "normalize_status",
    f"{cte('items')} select identificador, linea, parte, precio, {DUCK_STATUS} as estado_normal from items",
)
def normalize_status(spark, d):
    return view(spark, d, "items", wide=True).select(
        "identificador", "linea", "parte", "precio", status.normalize_status(C("estado")).alias("estado_normal")
    )


@query(
    "parse_dates_es",
    f"{cte('items')} select linea, parte, fecha_cierre as texto, {DUCK_DATE} as fecha from items",
)
def parse_dates_es(spark, d):
    return view(spark, d, "items", wide=True).select(
        "linea", "parte", C("fecha_cierre").alias("texto"), dates.parse_date_es(C("fecha_cierre")).alias("fecha")
    )


FORMATS = {
    1: "%d de %B de %Y",
    2: "%d/%m/%Y",
    3: "%d-%m-%Y",
    4: "%Y-%m-%dT%H:%M:%S",
    5: "Postulaciones hasta el %d de %B de %Y",
    6: "%d de %B de %Y",
    7: "%d/%m/%Y",
}


@query(
    "parse_dates_fmt",
    f"""{cte('items')} select linea, parte, fecha_cierre as texto,
        case when linea <= 3 or linea = 5 then cierre when linea = 4 then cierre + interval '23 hours 59 minutes 59 seconds'
        end as fecha from items""",
)
def parse_dates_fmt(spark, d):
    formats = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    parsed = dates.parse_date_fmt(C("fecha_cierre"), formats[C("linea")])
    return view(spark, d, "items", wide=True).select(
        "linea", "parte", C("fecha_cierre").alias("texto"), parsed.alias("fecha")
    )


@query(
    "parse_amounts",
    f"""{cte('items')} select parte, linea,
        cast(replace(replace(monto[16:], '.', ''), ',', '.') as double) as monto_valor from items""",
)
def parse_amounts(spark, d):
    return view(spark, d, "items", wide=True).select(
        "parte",
        "linea",
        amounts.parse_amount(text.rule_extract(C("monto"), F.lit(r"\$\s*([\d.,]+)"))).cast("double").alias("monto_valor"),
    )


@query(
    "regex_extract",
    f"""{cte('items')} select linea, parte,
        case when linea in (2, 3) then fecha_cierre when linea in (1, 5, 6) then right(fecha_cierre, 4)
        when linea = 4 then left(fecha_cierre, 4) end as extraido from items""",
)
def regex_extract(spark, d):
    """One pattern per row, some with a group and some without."""
    pattern = F.when(C("linea").isin(2, 3), r"\d{2}[/-]\d{2}[/-]\d{4}").otherwise(r"(?:de\s+|^)(\d{4})")
    return view(spark, d, "items", wide=True).select(
        "linea", "parte", text.rule_extract(C("fecha_cierre"), pattern).alias("extraido")
    )


@query(
    "surrogate_ids",
    "select p_partkey, 'hash-' || left(md5(p_name), 10) as identificador from part",
)
def surrogate_ids(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", text.surrogate_id("hash-", C("p_name")).alias("identificador")
    )


DAYS_SQL = f"cast(ceil(date_diff('microsecond', {NOW}, fecha_cierre) / 86400000000.0) as int)"


@query("days_to_close", f"{cte('convocatorias')} select id, {DAYS_SQL} as dias from convocatorias")
def days_to_close(spark, d):
    days = dates.days_to_close(C("fecha_cierre"), dates.at(AS_OF))
    return view(spark, d, "convocatorias").select("id", days.alias("dias"))


@query(
    "urgency_bands",
    f"""{cte('convocatorias')}, x as (select id, {DAYS_SQL} as dias from convocatorias)
        select id, case when dias is null then 'none' when dias < 0 then 'expired' when dias <= 10 then 'high'
        when dias <= 30 then 'mid' else 'low' end as urgencia,
        case when dias is null then 'Sin fecha' when dias < 0 then 'Vencida' when dias <= 10 then '⚡ ' || dias || 'd'
        when dias <= 30 then '⏳ ' || dias || 'd' else dias || 'd restantes' end as etiqueta from x""",
)
def urgency_bands(spark, d):
    days = dates.days_to_close(C("fecha_cierre"), dates.at(AS_OF))
    return (
        view(spark, d, "convocatorias")
        .select("id", days.alias("dias"))
        .select("id", dates.urgency_band(C("dias")).alias("urgencia"), dates.urgency_text(C("dias")).alias("etiqueta"))
    )


@query(
    "status_family",
    f"""{cte('items')} select linea, parte, estado, case when contains(upper(estado), 'ABIERT') then 'green'
        when regexp_matches(upper(estado), 'CERRAD|FINALIZAD|ADJUDICAD|SUSPENDID') then 'red'
        when contains(upper(estado), 'PROXIM') then 'amber' when contains(upper(estado), 'DESCONOCID') then 'gray'
        else 'cyan' end as familia from items""",
)
def status_family(spark, d):
    return view(spark, d, "items", wide=True).select("linea", "parte", "estado", status.status_family(C("estado")).alias("familia"))


@query(
    "recency_buckets",
    """with x as (select event_id, date_diff('microsecond', ts, cast('2024-01-20 12:00:00' as timestamp)) // 60000000
        as m, ts from events) select event_id, case when m < 1 or ts > cast('2024-01-20 12:00:00' as timestamp) then 'Ahora mismo' when m < 60 then 'hace ' || m || 'm'
        when m // 60 < 24 then 'hace ' || (m // 60) || 'h' else 'hace ' || (m // 1440) || 'd' end as hace from x""",
)
def recency_buckets(spark, d):
    return read(spark, d, "events").select(
        "event_id", dates.recency_text(C("ts"), dates.at("2024-01-20 12:00:00")).alias("hace")
    )


@query(
    "resolve_urls",
    """with x as (select page_id, url, replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '&amp;', '&') as href from pages),
        y as (select *, regexp_extract(url, '^(https?://[^/?#]*)', 1) as origin from x)
        select page_id, href, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href
        when starts_with(href, '/') then origin || href
        else origin || '/' || href end as absoluta,
        case when starts_with(href, '/') then rtrim(url, '/') || '/' || ltrim(href, '/') else href end as unida from y""",
)
def resolve_urls(spark, d):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    rows = read(spark, d, "pages").select("page_id", "url", hrefs.alias("href"))
    href = F.replace(C("href"), F.lit("&amp;"), F.lit("&"))
    return rows.select(
        "page_id",
        href.alias("href"),
        urls.resolve_url(href, C("url")).alias("absoluta"),
        urls.join_rooted(href, C("url")).alias("unida"),
    )


@query(
    "find_dates",
    """select doc_id, nullif(coalesce(nullif(regexp_extract(t, '(\\d{1,2}\\s+de\\s+\\w+\\s+de\\s+\\d{4})', 1, 'i'), ''),
        nullif(regexp_extract(t, '(\\d{2}/\\d{2}/\\d{4})', 1), ''), nullif(regexp_extract(t, '(\\d{2}-\\d{2}-\\d{4})', 1), ''),
        nullif(regexp_extract(t, 'hasta\\s+el\\s+(\\d{1,2}\\s+de\\s+\\w+(?:\\s+de\\s+\\d{4})?)', 1, 'i'), ''),
        nullif(regexp_extract(t, 'cierre[:\\s]+(\\d{1,2}\\s+de\\s+\\w+(?:\\s+de\\s+\\d{4})?)', 1, 'i'), '')), '') as fecha_texto
        from (select doc_id, text || case lang when 'en' then ' cierre 15 de agosto de 2026' when 'fr' then ' hasta el 3 de mayo'
        when 'de' then ' 01/02/2026' else ' Cierre: 7 de junio.' end as t from documents)""",
)
def find_dates(spark, d):
    tail = (
        F.when(C("lang") == "en", " cierre 15 de agosto de 2026")
        .when(C("lang") == "fr", " hasta el 3 de mayo")
        .when(C("lang") == "de", " 01/02/2026")
        .otherwise(" Cierre: 7 de junio.")
    )
    return read(spark, d, "documents").select(
        "doc_id", dates.find_date(F.concat("text", tail)).alias("fecha_texto")
    )


@query(
    "find_amounts",
    """select doc_id, trim(coalesce(nullif(regexp_extract(t, '(\\$[\\d.,]+(?:\\s*(?:CLP|UF|pesos|UFs))?)', 1, 'i'), ''),
        nullif(regexp_extract(t, '(\\d[\\d.]*(?:\\s*UF)s?)', 1, 'i'), ''),
        nullif(regexp_extract(t, '(?:monto|máximo|financiamiento)[:\\s]+(\\$?[\\d.,]+(?:\\s*(?:CLP|UF))?)', 1, 'i'), ''))) as monto_texto
        from (select doc_id, text || case lang when 'en' then ' $1.500.000 CLP' when 'fr' then ' hasta 250 UF'
        when 'de' then ' monto: 12.000' else '' end as t from documents)""",
)
def find_amounts(spark, d):
    tail = (
        F.when(C("lang") == "en", " $1.500.000 CLP")
        .when(C("lang") == "fr", " hasta 250 UF")
        .when(C("lang") == "de", " monto: 12.000")
        .otherwise("")
    )
    return read(spark, d, "documents").select(
        "doc_id", amounts.find_amount(F.concat("text", tail)).alias("monto_texto")
    )


@query(
    "read_deltas",
    f"""{cte('historial')} select id, case when es_apertura then 'APERTURA' else 'MODIFICACION' end as tipo,
        i as n, coalesce(delta::json->i->>'campo', '') as campo, delta::json->i->>'valor_anterior' as anterior,
        delta::json->i->>'valor_nuevo' as nuevo
        from historial, unnest(range(cast(json_array_length(delta) as bigint))) as r(i)""",
)
def read_deltas(spark, d):
    typed = changes.read_deltas(view(spark, d, "historial"))
    return typed.select("id", "tipo", F.posexplode("deltas").alias("n", "x")).select(
        "id",
        "tipo",
        C("n").cast("bigint").alias("n"),
        C("x.campo").alias("campo"),
        C("x.valor_anterior").alias("anterior"),
        C("x.valor_nuevo").alias("nuevo"),
    )


# --- normalization of whole rows ------------------------------------------------
def item_rules(spark, d):
    """Rules by source: some read dates by format, some amounts by pattern."""
    by_format = C("s_acctbal") > 5000
    return read(spark, d, "supplier").select(
        C("s_suppkey").alias("fuente_id"),
        F.concat(F.lit("https://f"), C("s_suppkey").cast("string"), F.lit(".example.org/")).alias("url_base"),
        by_format.alias("fecha_normaliza"),
        F.when(by_format, r"(\d{2}/\d{2}/\d{4})").alias("fecha_regex"),
        F.when(by_format, "%d/%m/%Y").alias("fecha_formato"),
        (C("s_acctbal") > 0).alias("monto_normaliza"),
        F.when(C("s_acctbal") > 0, r"\$([\d.,]+)").alias("monto_regex"),
        F.when(C("s_nationkey") > 10, "Biobío").alias("region_defecto"),
    )


ITEM_STAGES = f"""{cte('items')},
    leidas as (select i.*, s_acctbal, s_nationkey, {DUCK_STATUS} as st,
        case when s_acctbal > 5000 then (case when linea = 2 then cierre end) else {DUCK_DATE} end as fc
        from items i left join supplier on fuente_id = s_suppkey),
    normales as (select fuente_id, identificador, titulo, descripcion,
        case when starts_with(url_detalle, '/') then 'https://f' || fuente_id || '.example.org' || url_detalle
        else url_detalle end as url_detalle, fc as fecha_cierre, cierre, parte, precio,
        case when s_acctbal > 0 then cast(replace(replace(monto[16:], '.', ''), ',', '.') as decimal(15,2)) end as monto,
        coalesce(region, case when s_nationkey > 10 then 'Biobío' end) as region,
        case when st = 'DESCONOCIDO' and fc >= {NOW} then 'ABIERTO' else st end as estado,
        case when identificador is null then 'sin_identificador' when url_detalle is null then 'sin_url'
        when s_acctbal > 5000 and linea <> 2 then 'fecha_invalida' when fc < {NOW} then 'expirada' end as reject_reason
        from leidas)"""


@query(
    "normalize_calls",
    f"""{ITEM_STAGES} select sha2 as id, * exclude (sha2, cierre, parte, precio, monto, reject_reason), cast(monto as double) as monto
        from (select *, sha256(fuente_id || chr(31) || identificador) as sha2 from normales where reject_reason is null)""",
)
def normalize_calls(spark, d):
    calls = normalize.normalize_calls(view(spark, d, "items", wide=True), item_rules(spark, d), AS_OF)
    return calls.withColumnRenamed("identificador_externo", "identificador").select(
        "id", "fuente_id", "identificador", "titulo", "descripcion", "url_detalle", "fecha_cierre",
        C("monto").cast("double").alias("monto"), "region", "estado",
    )


# --- filters ----------------------------------------------------------------------
@query(
    "filter_relevant",
    f"""{cte('convocatorias')} select id, titulo, regexp_matches(concat_ws(' ', titulo, descripcion),
        '\\b(fondo|fondos|concurso\\s+(de\\s+)?(proyecto|startup)|programa\\s+(de\\s+)?(fondos|subsidio|apoyo|fomento))\\b', 'i') as has_positive
        from convocatorias where not {DUCK_EXCLUDED}""",
)
def filter_relevant(spark, d):
    return filters.filter_relevant(view(spark, d, "convocatorias")).select("id", "titulo", "has_positive")


@query(
    "filter_title_year",
    f"{cte('convocatorias')} select id, titulo from convocatorias where not ({DUCK_OLD_YEAR.format(year=2001)})",
)
def filter_title_year(spark, d):
    calls = view(spark, d, "convocatorias").select("id", "titulo")
    return filters.filter_title_year(calls, "2001-06-01 00:00:00")


@query(
    "relevance_summary",
    f"""{cte('convocatorias')} select case when {DUCK_EXCLUDED} then 'exclusion' when {DUCK_OLD_YEAR.format(year=2001)}
        then 'fecha_titulo' else 'vigente' end as reason, count(*) as n from convocatorias group by 1""",
)
def relevance_summary(spark, d):
    return filters.relevance_summary(view(spark, d, "convocatorias"), "2001-06-01 00:00:00")


def duck_liveness(closing: str, st: str) -> str:
    return (
        f"case when {st} in ('CERRADO', 'ADJUDICADO', 'SUSPENDIDO', 'FINALIZADO') then 'estado' "
        f"when {st} in ('ABIERTO', 'PROXIMAMENTE') then case when {closing} < {NOW} - interval 90 day then 'ventana' end "
        f"when {closing} < {NOW} then 'fecha' end"
    )


@query(
    "filter_live",
    f"{cte('convocatorias')} select id, estado, fecha_cierre from convocatorias where ({duck_liveness('fecha_cierre', 'estado')}) is null",
)
def filter_live(spark, d):
    return filters.filter_live(view(spark, d, "convocatorias"), AS_OF).select("id", "estado", "fecha_cierre")


@query(
    "live_summary",
    f"""{cte('items')} select coalesce({duck_liveness('cierre', 'st')}, 'vigente') as reason, count(*) as n
        from (select *, {DUCK_STATUS} as st from items) group by 1""",
)
def live_summary(spark, d):
    items = view(spark, d, "items", wide=True).withColumn("fecha_cierre", C("cierre"))
    return filters.live_summary(items, AS_OF)


@query(
    "filter_live_raw",
    f"""{cte('items')}, x as (select *, {DUCK_STATUS} as st, {DUCK_DATE} as fc from items)
        select linea, parte, estado, fecha_cierre from x where ({duck_liveness('fc', 'st')}) is null""",
)
def filter_live_raw(spark, d):
    return filters.filter_live_raw(view(spark, d, "items", wide=True), AS_OF).select("linea", "parte", "estado", "fecha_cierre")


KEYWORDS_SQL = "\\b(" + "|".join(fixed.FEED_KEYWORDS) + ")\\b"


@query(
    "filter_keywords",
    f"""select doc_id, regexp_matches(t, '{KEYWORDS_SQL}', 'i') as aceptado from (select doc_id,
        case source when 'src0' then 'Nuevo Concurso' when 'src1' then 'Agenda semanal' when 'src2' then 'Capital y crece' else 'Noticia' end
        || ' ' || text as t from documents)""",
)
def filter_keywords(spark, d):
    title = (
        F.when(C("source") == "src0", "Nuevo Concurso")
        .when(C("source") == "src1", "Agenda semanal")
        .when(C("source") == "src2", "Capital y crece")
        .otherwise("Noticia")
    )
    docs = read(spark, d, "documents")
    return docs.select("doc_id", filters.has_keyword(title, C("text"), fixed.FEED_KEYWORDS).alias("aceptado"))


@query(
    "explicit_empty",
    """select doc_id, contains(lower(text), 'no hay') or contains(lower(text), 'sin concursos') or contains(lower(text), 'the was')
        or contains(lower(text), 'und der') as vacia from documents""",
)
def explicit_empty(spark, d):
    markers = F.array(*[F.lit(m) for m in ("No hay", "sin concursos", "The was", "UND der")])
    return read(spark, d, "documents").select(
        "doc_id", filters.is_explicitly_empty(C("text"), markers).alias("vacia")
    )


@query(
    "exclude_patterns",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey as fuente_id, l_returnflag || ' ' || p_name as titulo,
        'https://x.example.org/' || p_type || '/' || p_partkey || '.PDF' as url_detalle
        from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
        where not (s_acctbal < 0 and regexp_matches(l_returnflag || ' ' || p_name, '^a |ring$', 'i'))
        and not (s_acctbal > 8000 and contains(lower('https://x.example.org/' || p_type || '/' || p_partkey || '.PDF'), 'economy'))""",
)
def exclude_patterns(spark, d):
    nothing = F.array().cast("array<string>")
    rules = read(spark, d, "supplier").select(
        C("s_suppkey").alias("fuente_id"),
        F.when(C("s_acctbal") < 0, F.array(F.lit("^a "), F.lit("RING$"))).otherwise(nothing).alias("excluir_patrones_titulo"),
        F.when(C("s_acctbal") > 8000, F.array(F.lit("Economy"))).otherwise(nothing).alias("excluir_patrones_url"),
    )
    items = (
        read(spark, d, "lineitem")
        .join(read(spark, d, "part"), C("p_partkey") == C("l_partkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", C("l_suppkey").alias("fuente_id"),
            F.concat_ws(" ", "l_returnflag", "p_name").alias("titulo"),
            F.concat(F.lit("https://x.example.org/"), "p_type", F.lit("/"), C("p_partkey").cast("string"), F.lit(".PDF")).alias("url_detalle"),
        )
    )
    return filters.exclude_patterns(items, rules)


@query(
    "list_calls",
    f"""{cte('convocatorias')} select id, titulo, estado, region from convocatorias
        where estado = 'ABIERTO' and region = 'Nacional' and titulo ilike '%FONDO%'""",
)
def list_calls(spark, d):
    wanted = filters.call_predicate(estado="ABIERTO", region="Nacional", search="FONDO")
    return view(spark, d, "convocatorias").where(wanted).select("id", "titulo", "estado", "region")


@query(
    "due_soon",
    f"{cte('convocatorias')} select id, fecha_cierre from convocatorias where fecha_cierre >= {NOW} order by fecha_cierre, id",
)
def due_soon(spark, d):
    return filters.due_soon(view(spark, d, "convocatorias").select("id", "fecha_cierre"), AS_OF)


@query("active_sources", f"{cte('fuentes')} select id, nombre from fuentes where activa")
def active_sources(spark, d):
    return filters.active_sources(view(spark, d, "fuentes")).select("id", "nombre")


@query(
    "lookup_call",
    f"{cte('convocatorias')} select id, titulo from convocatorias where fuente_id = 899 and identificador_externo = 'C-0'",
)
def lookup_call(spark, d):
    return filters.lookup_call(view(spark, d, "convocatorias"), 899, "C-0").select("id", "titulo")


@query("search_sources", f"{cte('fuentes')} select id, nombre from fuentes where contains(lower(nombre), 'r#00000012')")
def search_sources(spark, d):
    return filters.search_sources(view(spark, d, "fuentes"), "R#00000012").select("id", "nombre")


@query(
    "exclude_by_index",
    """with i as (select l_orderkey, l_linenumber, l_partkey, l_suppkey as fuente_id, l_returnflag || ' ' || p_name as titulo,
        'https://x.example.org/' || p_type || '/' || p_partkey || '.PDF' as url_detalle from lineitem join part on p_partkey = l_partkey),
        t as (select distinct fuente_id, titulo from i),
        x as (select distinct fuente_id, titulo from t join part q on q.p_partkey % 101 = fuente_id % 101 where contains(lower(titulo), lower(q.p_name)))
        select i.* from i join supplier on s_suppkey = fuente_id where not exists (select 1 from x where x.fuente_id = i.fuente_id and x.titulo = i.titulo)
        and not (s_acctbal < 0 and regexp_matches(titulo, '^(a|r) |s.+ring$', 'i'))
        and not (s_acctbal > 8000 and contains(lower(url_detalle), 'economy'))""",
)
def exclude_by_index(spark, d):
    """Each source excludes a share of all part names, some of them also patterns without a needed text, some URL parts."""
    none = F.array().cast("array<string>")
    named = read(spark, d, "part").select((C("p_partkey") % 101).alias("lista"), F.upper("p_name").alias("nombre")).distinct()
    shares = named.groupBy("lista").agg(F.collect_list("nombre").alias("excluir_patrones_titulo")).withColumn("excluir_patrones_url", none)
    rules = read(spark, d, "supplier").select(
        C("s_suppkey").alias("fuente_id"),
        F.array(C("s_suppkey") % 101).alias("listas"),
        F.when(C("s_acctbal") < 0, F.array(F.lit("^(a|r) "), F.lit("S.+RING$"))).otherwise(none).alias("excluir_patrones_titulo"),
        F.when(C("s_acctbal") > 8000, F.array(F.lit("Economy"))).otherwise(none).alias("excluir_patrones_url"),
    )
    items = read(spark, d, "lineitem").join(read(spark, d, "part"), C("p_partkey") == C("l_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", C("l_suppkey").alias("fuente_id"),
        F.concat_ws(" ", "l_returnflag", "p_name").alias("titulo"),
        F.concat(F.lit("https://x.example.org/"), "p_type", F.lit("/"), C("p_partkey").cast("string"), F.lit(".PDF")).alias("url_detalle"),
    )
    known = items.join(rules.select("fuente_id"), "fuente_id", "left_semi")
    return pattern_index.exclude_by_index(known, rules, shares).select(*items.columns)
