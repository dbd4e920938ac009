"""Queries over raw captures: landing, paging, and item extraction.

Raw bodies are put together from table rows with SQL text expressions that
Spark and DuckDB share, so every extraction reads a body that grows with the
tables and its result is known from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.operators import extract_feed as feeds
from atalaya.operators import extract_html as pages_html
from atalaya.operators import extract_json as json_items
from atalaya.operators import registry, responses
from atalaya.plans.registry import query
from atalaya.plans.tables import cte, read, spread, view
from atalaya.sources import captures, paging, profiles, rules

C = F.col
KEY = "cast(o_orderkey as string)"


# --- sources ------------------------------------------------------------------
@query(
    "ingest_snapshots",
    f"""{cte('capturas')} select fuente_id, fecha_captura, sha256(contenido_crudo) as hash_contenido,
        'SUCCESS' as estado_ejecucion from capturas""",
)
def ingest_snapshots(spark, d):
    return captures.ingest_snapshots(view(spark, d, "capturas")).drop("id", "contenido_crudo")


RULE_TEXT = r"""case when s_nationkey < 2 then 'nombre: [sin cierre' when s_nationkey = 2 then '- uno' || chr(10) || '- dos'
    when s_nationkey = 3 then '' when s_nationkey = 4 then 'url_busqueda: https://x.example.org/'
    when s_nationkey = 5 then 'nombre: A' || chr(10) || 'url_busqueda: sin-esquema'
    when s_nationkey = 6 then 'nombre: A' || chr(10) || 'url_busqueda: https://x.example.org/' || chr(10) || 'selectores: {identificador: a, titulo: h2}'
    else 'nombre: "' || s_name || '"' || chr(10) || 'url_busqueda: https://s' || cast(s_suppkey as string) || '.example.org/lista' || chr(10)
    || case when s_acctbal > 5000 then 'estrategia: json_api' || chr(10) else '' end
    || 'selectores:' || chr(10) || '  contenedor_items: div.item' || chr(10) || '  identificador: "attr:data-id"' || chr(10) || '  titulo: h2.title' || chr(10)
    || 'normalizadores: {fecha_cierre: {regex_extraction: "(\\d+)", formato_salida: "%d/%m/%Y"}}' || chr(10)
    || 'alertas:' || chr(10) || '  campos_sensibles: [estado, monto]' || chr(10) end"""


@query(
    "load_rules",
    r"""select 'r' || s_suppkey as archivo, case when s_nationkey in (5, 6) then 'A' when s_nationkey > 6 then s_name end as nombre,
        case when s_nationkey > 6 and s_acctbal > 5000 then 'json_api' else 'html_static' end as estrategia,
        case when s_nationkey > 6 then 'div.item' end as contenedor, case when s_nationkey > 6 then '(\d+)' end as patron,
        case when s_nationkey > 6 then 2 else 0 end as sensibles,
        case when s_nationkey < 2 then 'yaml_invalido' when s_nationkey < 4 then 'no_es_diccionario' when s_nationkey = 4 then 'falta_nombre'
        when s_nationkey = 5 then 'url_invalida' when s_nationkey = 6 then 'faltan_selectores' end as reject_reason from supplier""",
)
def load_rules(spark, d):
    documents = read(spark, d, "supplier").selectExpr(
        "'r' || cast(s_suppkey as string) as archivo", RULE_TEXT.replace(r"\\d", r"\\\\d") + " as texto"
    )
    return rules.load_rules(documents).select(
        "archivo", "nombre", "estrategia",
        C("selectores.contenedor_items").alias("contenedor"),
        C("normalizadores.fecha_cierre.regex_extraction").alias("patron"),
        F.coalesce(F.size("alertas.campos_sensibles"), F.lit(0)).alias("sensibles"),
        "reject_reason",
    )


def _profiles(spark, d) -> DataFrame:
    return read(spark, d, "nation").select(
        C("n_nationkey").alias("ordinal"), C("n_name").alias("key"),
        F.array(F.concat("n_name", F.lit("_API")), F.concat(F.lit("País "), C("n_nationkey").cast("string"))).alias("aliases"),
        F.concat(F.lit("https://n"), C("n_nationkey").cast("string"), F.lit(".example.org/")).alias("root_url"),
        F.concat(F.lit("https://n"), C("n_nationkey").cast("string"), F.lit(".example.org/lista")).alias("list_url"),
    )


SOURCE_NAME = """case c_mktsegment when 'BUILDING' then 'Nation ' || cast(c_nationkey as string) when 'MACHINERY' then 'nation-' || cast(c_nationkey as string) || ' (api)'
    when 'FURNITURE' then 'Pas ' || cast(c_nationkey as string) when 'AUTOMOBILE' then 'Naciön ' || cast(c_nationkey as string) else c_name end"""


@query(
    "resolve_sources",
    """select c_custkey as id, case when c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE') then n_name end as perfil,
        case when c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE') then 'https://n' || n_nationkey || '.example.org/' else 'https://propia/' end as url_base,
        case when c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE') then 'https://n' || n_nationkey || '.example.org/lista' else 'https://propia/l' end as url_busqueda
        from customer join nation on n_nationkey = c_nationkey""",
)
def resolve_sources(spark, d):
    """Names match by letters and digits only; accented letters drop out."""
    sources = read(spark, d, "customer").selectExpr(
        "c_custkey as id", f"{SOURCE_NAME} as nombre", "'https://propia/' as url_base", "'https://propia/l' as url_busqueda"
    )
    return profiles.resolve_sources(sources, _profiles(spark, d)).drop("nombre")


@query(
    "list_profiles",
    """select key, ordinal, root_url from (select n_name as key, s_suppkey as ordinal, 'https://' || s_name as root_url,
        row_number() over (partition by n_name order by s_suppkey) as rn from supplier join nation on n_nationkey = s_nationkey) where rn = 1""",
)
def list_profiles(spark, d):
    named = read(spark, d, "supplier").join(read(spark, d, "nation"), C("n_nationkey") == C("s_nationkey"))
    rows = named.select(
        C("n_name").alias("key"), C("s_suppkey").alias("ordinal"),
        F.concat(F.lit("https://"), "s_name").alias("root_url"), F.lit("l").alias("list_url"),
    )
    return profiles.list_profiles(rows).select("key", "ordinal", "root_url")


# --- paging -------------------------------------------------------------------
@query(
    "consolidate_pages_short",
    f"""{cte('paginas')}, x as (select fuente_id, coalesce(least(min(page) filter (n_items < 20), min(page - 1) filter (n_items is null)), max(page)) as u from paginas group by 1)
        select fuente_id, page, n_items from paginas join x using (fuente_id) where page <= u""",
)
def consolidate_pages_short(spark, d):
    """The page bodies are JSON lists; their sizes decide."""
    bodies = view(spark, d, "paginas", wide=True).withColumn(
        "body",
        F.when(C("n_items").isNull(), F.lit('{"error": true}')).otherwise(
            F.to_json(F.array_repeat(C("page"), C("n_items")))
        ),
    )
    sized = bodies.withColumn("n_items", paging.page_size(C("body"))).drop("body")
    return paging.consolidate_pages_short(sized, 20).select("fuente_id", "page", "n_items")


@query(
    "consolidate_pages_total",
    f"""{cte('paginas')}, x as (select fuente_id, least(greatest(coalesce(max(total_pages) filter (page = 1), 1), 1), min(page) filter (n_items = 0)) as u
        from paginas group by 1) select fuente_id, page, n_items from paginas join x using (fuente_id) where page <= u""",
)
def consolidate_pages_total(spark, d):
    return paging.consolidate_pages_total(view(spark, d, "paginas")).select("fuente_id", "page", "n_items")


@query(
    "consolidate_pages_found",
    f"""{cte('paginas')}, x as (select fuente_id, max(found) filter (page = 1) as f, min(page) filter (html = '') - 1 as e from paginas group by 1),
        y as (select fuente_id, page, min(html) as html, any_value(f) as f from paginas join x using (fuente_id)
        where page <= coalesce(least(case when f > 0 then cast(ceil(f / 10.0) as int) end, e), page) group by 1, 2)
        select fuente_id, string_agg(html, chr(10) order by page) as html, case when min(page) = 1 then any_value(f) end as total_found,
        max(page) as pages_fetched from y group by 1""",
)
def consolidate_pages_found(spark, d):
    kept = paging.consolidate_pages_found(view(spark, d, "paginas"))
    return paging.merge_found_pages(kept).drop("run_id", "hash_contenido")


BUNDLE = f"""'ruido' || chr(10) || '===PAGE:uno===' || chr(10) || '<p>' || {KEY} || '</p>' || chr(10) || '===ENDPAGE===' || chr(10)
    || 'entre' || chr(10) || '===PAGE:dos===' || chr(10) || o_orderpriority || chr(10) || '===' || chr(10) || '===PAGE:tres===' || chr(10) || o_orderstatus"""


@query(
    "split_bundle",
    f"""select o_orderkey, unnest(['uno', 'dos', 'tres']) as nombre, unnest(['<p>' || {KEY} || '</p>', o_orderpriority || chr(10) || '===', o_orderstatus]) as html from orders""",
)
def split_bundle(spark, d):
    bundles = read(spark, d, "orders").selectExpr("o_orderkey", f"{BUNDLE} as contenido_crudo")
    return captures.split_bundle(bundles).select("o_orderkey", "nombre", "html")


@query(
    "page_urls",
    """select s_suppkey, i as page, 'https://api.example.org/v?idRegion=' || s_nationkey || '&pagina=' || i || '&cantidad=500' as page_url
        from supplier, unnest(range(1, cast(s_nationkey + 2 as bigint))) as r(i)""",
)
def page_urls(spark, d):
    sources = read(spark, d, "supplier").select(
        "s_suppkey", (C("s_nationkey") + 1).alias("paginas"),
        F.concat(F.lit("https://api.example.org/v?idRegion="), C("s_nationkey").cast("string"), F.lit("&pagina=1&cantidad=500")).alias("url"),
    )
    return paging.page_urls(sources, "pagina").select("s_suppkey", "page", "page_url")


TOKENS = """case lang when 'en' then '<script>var x = {"nonce" : "' || md5(text) || '","ajaxurl":"https:\\/\\/h.example.org\\/a.php"}</script>'
    when 'fr' then '<script>var x = {"ajaxurl":"","nonce":"' || source || '"}</script>' else '' end || text"""


@query(
    "extract_tokens",
    """select doc_id, case lang when 'en' then md5(text) when 'fr' then source end as nonce,
        case lang when 'en' then 'https://h.example.org/a.php' else 'https://p.example.org/wp-admin/admin-ajax.php' end as ajax_url,
        case when lang not in ('en', 'fr') then 'sin_nonce' end as reject_reason from documents""",
)
def extract_tokens(spark, d):
    rows = read(spark, d, "documents").selectExpr(
        "doc_id", "'https://p.example.org/lista/' as url", TOKENS.replace("\\/", "\\\\/") + " as html"
    )
    return captures.extract_tokens(rows).drop("url", "html")


def _spark_sql(text: str) -> str:
    return text.replace("\\", "\\\\")


# --- HTML ---------------------------------------------------------------------
def _listing(spark, d, parts: str) -> DataFrame:
    """One page per order: three copies of a card, numbered by ``n``."""
    return spread(read(spark, d, "orders")).selectExpr(
        "o_orderkey", "'https://portal.example.org/lista/' as url_base",
        f"'<html><head><title>x</title></head><body><ul class=menu><li>a<li>b</ul>' || array_join(transform(sequence(1, 3), n -> {parts}), chr(10)) || '</body></html>' as html",
    )


N = "cast(n as string)"
CARD = f"""'<div class="item big" data-id="' || case when n < 3 then {KEY} || '-' || {N} else '' end || '"><h2 class="title"> Fondo <b>' || {N} || '</b> &amp; ' || {KEY} || '</h2><p class="desc">'
    || o_orderpriority || '<p class="otra">x</p><a class="link" href="' || case n when 1 then '/f/' || {KEY} when 2 then '../g?id=' || {KEY} else 'h' end || '">Ver</a><span class="status">'
    || case o_orderstatus when 'O' then 'Abierta' when 'F' then 'cerrado' else 'otro' end || '</span><span class="date">Cierre: 0' || {N} || '/08/2026</span><i>' || {KEY} || '</i></div>'"""


@query(
    "extract_html",
    f"""select o_orderkey, cast(n - 1 as int) as pos, case when n < 3 then {KEY} || '-' || n else 'hash-' || left(md5('Fondo' || n || '& ' || {KEY}), 10) end as identificador,
        'Fondo' || n || '& ' || {KEY} as titulo, o_orderpriority as descripcion,
        case n when 1 then 'https://portal.example.org/f/' || {KEY} when 2 then 'https://portal.example.org/g?id=' || {KEY} else 'https://portal.example.org/lista/h' end as url_detalle,
        case o_orderstatus when 'O' then 'ABIERTO' when 'F' then 'CERRADO' else 'DESCONOCIDO' end as estado, '0' || n || '/08/2026' as fecha_cierre
        from orders, unnest([1, 2, 3]) as r(n)""",
)
def extract_html(spark, d):
    rule = pages_html.HtmlRule(
        contenedor_items="div.item", identificador="attr:data-id", titulo="h2.title", descripcion="div > p.desc, .nada",
        link_detalle="a[href]", estado=".item .status", fecha_cierre="span.date", patrones={"fecha_cierre": r"(\d{2}/\d{2}/\d{4})"},
    )
    return pages_html.extract_html(_listing(spark, d, CARD), rule).drop("url_base", "monto", "region", "regex_aplicada")


FICHA = f"""'<a href="/ficha/' || {KEY} || '/' || {N} || '"><span class="badge">ABIERTO</span><h6>Fondo ' || {KEY} || '-' || {N} || '</h6><div>Fechas:</div><div>Inicio: 01-02-2026|Fin: '
    || case when n = 3 then 'pronto' else '0' || {N} || '-12-2026' end || '</div><div>Montos:</div><div>Hasta $' || {KEY} || '.000</div></a>'"""


@query(
    "extract_fulltext",
    f"""select o_orderkey, 'Fondo ' || {KEY} || '-' || n as identificador, 'https://portal.example.org/ficha/' || {KEY} || '/' || n as url_detalle,
        case when n < 3 then '0' || n || '-12-2026' end as fecha_cierre, '$' || {KEY} || '.000' as monto from orders, unnest([1, 2, 3]) as r(n)""",
)
def extract_fulltext(spark, d):
    """Dates and amounts that only the item's whole text has; no match is NULL."""
    rule = pages_html.HtmlRule(
        contenedor_items="a[href^='/ficha/']", identificador="h6", titulo="h6", link_detalle="attr:href", estado=".badge",
        patrones={"fecha_cierre": r"Fin:\s*(\d{2}-\d{2}-\d{4})", "monto": r"Montos:[^\n]*?([\$\d\.]{2,})"},
    )
    items = pages_html.extract_html(_listing(spark, d, FICHA), rule)
    return items.select("o_orderkey", "identificador", "url_detalle", "fecha_cierre", "monto")


# --- rules of many sources -------------------------------------------------------
K = "cast(c_custkey as string)"
#: A rule document per customer: four strategies, selectors and patterns of its own; some documents are bad.
SOURCE_RULE = f"""'nombre: "f' || {K} || '"' || chr(10) || 'url_busqueda: "https://f' || {K} || '.example.org/lista"' || chr(10)
    || case c_custkey % 5 when 1 then 'estrategia: json_api' || chr(10) || 'json_mapping: {{root_path: "d' || {K} || '.0.lista", identificador: id, titulo: "t.' || cast(c_custkey % 3 as string) || '", monto: m}}' || chr(10)
    when 4 then 'estrategia: desconocida' || chr(10) else
    case c_custkey % 5 when 2 then 'estrategia: wp_ajax' || chr(10) else '' end
    || 'selectores: {{contenedor_items: "div.k' || {K} || '", identificador: "attr:data-id", titulo: "h2.t' || cast(c_custkey % 7 as string) || case when c_custkey % 35 = 3 then '::before' else '' end
    || '", descripcion: "section.s > div p[title=' || chr(39) || 'a, b' || chr(39) || ']", link_detalle: "a.ver", estado: "b"}}' || chr(10)
    || 'normalizadores: {{monto: {{regex_extraction: "' || case when c_custkey % 35 = 5 then '(mal' when c_custkey % 2 = 0 then '(?P<v>[0-9]+) pesos' else 'vale [(]([0-9]+)' end || '"}}}}' || chr(10)
    || 'excluir_patrones_titulo: ["' || case when c_custkey % 3 = 0 then '^CARTEL' else 'nada$' end || '"]' || chr(10)
    || 'excluir_patrones_url: ["/' || case when c_custkey % 4 = 0 then 'FUERA' else 'nunca' end || '/"]' || chr(10) end"""
RULED_PAGE = f"""'<section class="s"><div class="item k' || {K} || ' z" data-id="' || {KEY} || '-' || {N} || '"><h2 class="t' || cast(c_custkey % 7 as string) || '">' || case when n = 2 then 'Cartel ' else 'Pedido ' end || {KEY}
    || '</h2><p title="a, b">' || o_orderpriority || '</p><p>vale (' || {KEY} || ') o ' || {KEY} || '1 pesos</p><b>abierto</b><a class="ver" href="/' || case when n = 3 then 'fuera' else 'd' end || '/' || {N} || '">x</a></div><div class="k' || {K} || '0">no</div></section>'"""
RULED_JSON = f"""'{{"d' || {K} || '": [{{"lista": [{{"id": ' || {KEY} || ', "t": ["uno", "dos", "tres"], "m": ' || {KEY} || '.5}}, {{"id": "x", "t": {{"0": "a", "1": "b", "2": "c"}}}}]}}]}}' || case when o_orderkey % 8 = 0 then ' y' else '' end"""


@query(
    "extract_by_rules",
    f"""with x as (select *, case when c_custkey % 5 = 4 then 'estrategia_desconocida' when c_custkey % 35 in (3, 5) then 'sin_regla'
            when c_custkey % 5 = 1 and o_orderkey % 8 = 0 then 'json_invalido' end as reject_reason from orders join customer on c_custkey = o_custkey),
        y as (select *, unnest(case when reject_reason is not null then [0] when c_custkey % 5 = 1 then [1, 2] else [1, 2, 3] end) as n from x)
        select o_orderkey, reject_reason, cast(n - 1 as int) as pos, {KEY} || '-' || n as identificador, case when n = 2 then 'Cartel ' else 'Pedido ' end || {KEY} as titulo, o_orderpriority as descripcion,
        'https://f' || c_custkey || '.example.org/' || case when n = 3 then 'fuera' else 'd' end || '/' || n as url_detalle, 'ABIERTO' as estado,
        case when c_custkey % 2 = 0 then {KEY} || '1' else {KEY} end as monto from y where n > 0 and c_custkey % 5 <> 1
        and not (n = 2 and c_custkey % 3 = 0) and not (n = 3 and c_custkey % 4 = 0)
        union all select o_orderkey, null, cast(n - 1 as int), case n when 1 then {KEY} else 'x' end,
        (case n when 1 then ['uno', 'dos', 'tres'] else ['a', 'b', 'c'] end)[1 + c_custkey % 3], null, null, 'DESCONOCIDO', case when n = 1 then {KEY} || '.5' end from y where n > 0 and c_custkey % 5 = 1
        union all select o_orderkey, reject_reason, null, null, null, null, null, null, null from y where n = 0""",
)
def extract_by_rules(spark, d):
    """Every order is a capture of its customer's source; rules come from YAML, bad ones set only their own source apart."""
    sources = read(spark, d, "customer").selectExpr("c_custkey as id", f"'f' || {K} as nombre")
    documents = read(spark, d, "customer").selectExpr(f"{K} as archivo", f"{_spark_sql(SOURCE_RULE)} as texto")
    known = registry.source_rules(sources, rules.valid_rules(rules.load_rules(documents)))
    page = f"array_join(transform(sequence(1, 3), n -> {RULED_PAGE}), chr(10))"
    bodies = spread(read(spark, d, "orders")).join(read(spark, d, "customer"), C("c_custkey") == C("o_custkey")).selectExpr(
        "o_orderkey", "o_custkey as fuente_id", f"'https://f' || {K} || '.example.org/lista' as url_base",
        f"case c_custkey % 5 when 1 then {RULED_JSON} when 2 then to_json(named_struct('html', {page})) else {page} end as contenido_crudo",
    )
    read_once = registry.read_by_rules(bodies, known)
    columns = ["o_orderkey", "reject_reason", "pos", "identificador", "titulo", "descripcion", "url_detalle", "estado", "monto"]
    return registry.items_by_rules(read_once, with_rejects=True).select(columns)


PROGRAM = f"""'<div style="color:red; background-color: #fff"><h2>' || case when n = 3 then 'Programa repetido ' else 'Programa abierto ' end || {KEY} || '</h2><p>' || o_orderpriority
    || '</p><a class="btn big" href="/es/programas/' || {KEY} || case when n = 2 then '-b' else '' end || '/">Ver</a></div><div style="background-color:x"><h2>Sin enlace</h2></div>'"""


@query(
    "extract_cards",
    f"""select o_orderkey, {KEY} || s as identificador, 'Programa abierto ' || {KEY} as titulo, o_orderpriority as descripcion,
        'https://www.example.org/es/programas/' || {KEY} || s || '/' as url_detalle, 'ABIERTO' as estado from orders, unnest(['', '-b']) as r(s)""",
)
def extract_cards(spark, d):
    rows = _listing(spark, d, PROGRAM).drop("url_base").withColumn("page_ord", F.lit(0))
    cards = pages_html.extract_cards(rows, "https://www.example.org/", ["o_orderkey"])
    return cards.drop("pos", "page_ord")


ALLIANCE = f"""'<a href="/es/convocatoria-alianzas/' || case n when 1 then 'c' || {KEY} || '">Convocatoria abierta ' || {KEY} when 2 then 'c' || {KEY} || '">La misma convocatoria otra vez'
    else '">Todas las convocatorias de alianza' end || '</a><a href="/es/convocatoria-alianzas/edit/' || {KEY} || '">Editar esta convocatoria</a><a href="/otra/">Otra cosa que no corresponde</a>'"""


@query(
    "extract_links",
    f"""select o_orderkey, 'alianza-c' || {KEY} as identificador, 'Convocatoria abierta ' || {KEY} as titulo,
        'Convocatoria de alianza institucional: Convocatoria abierta ' || {KEY} as descripcion,
        'https://www.example.org/es/convocatoria-alianzas/c' || {KEY} as url_detalle, 'ABIERTO' as estado from orders""",
)
def extract_links(spark, d):
    rows = _listing(spark, d, ALLIANCE).drop("url_base").withColumn("page_ord", F.lit(0))
    return pages_html.extract_links(rows, "https://www.example.org/", ["o_orderkey"]).drop("pos", "page_ord")


NEWS = f"""'<div><div><div><div><div><div><span>' || case n when 1 then '12 de mayo de 2026' else '' end || '</span><a href="/sala-de-prensa/' || case when n = 3 then 'n1-' else 'n' || {N} || '-' end || {KEY} || '%20x">'
    || case when n = 2 then 'Entrevista semanal ' else 'Nuevo fondo municipal ' end || {KEY} || '</a><p>' || case when n = 2 then 'Charla' else 'Texto' end || ' ' || {KEY} || '</p></div></div></div></div></div></div>'
    || '<a href="https://facebook.com/sala-de-prensa/' || {KEY} || '">Compartir esta noticia en la red</a><a href="/programas/divisi/p-' || {KEY} || '">Programa ' || {KEY} || '</a><a href="/programas/divisi/division-x">Otra</a>'"""


@query(
    "extract_news",
    f"""select o_orderkey, 'n1-' || {KEY} || ' x' as identificador, 'Nuevo fondo municipal ' || {KEY} as titulo, 'Texto ' || {KEY} as descripcion,
        'https://www.example.org/sala-de-prensa/n1-' || {KEY} || '%20x' as url_detalle, 'DESCONOCIDO' as estado from orders""",
)
def extract_news(spark, d):
    rows = _listing(spark, d, NEWS).drop("url_base")
    found = pages_html.extract_news(rows, "https://www.example.org/")
    return found.drop("pos", "href", "fecha_cierre")


@query(
    "extract_featured",
    f"""select o_orderkey, 'p-' || {KEY} as identificador, 'Programa ' || {KEY} as titulo,
        'https://www.example.org/programas/divisi/p-' || {KEY} as url_detalle, 'DESCONOCIDO' as estado from orders""",
)
def extract_featured(spark, d):
    rows = _listing(spark, d, NEWS).drop("url_base")
    found = pages_html.extract_featured(rows, "https://www.example.org/", ["o_orderkey"])
    return found.drop("pos", "href", "descripcion")


@query(
    "unwrap_ajax",
    f"""select o_orderkey, {KEY} || ' h' as titulo, o_orderpriority as estado_texto from orders""",
)
def unwrap_ajax(spark, d):
    """Half of the bodies are JSON wrappers, half are plain html."""
    html = "'<div class=\"caja\"><h4>' || cast(o_orderkey as string) || ' h</h4><h6>' || o_orderpriority || '</h6></div>'"
    rows = spread(read(spark, d, "orders")).selectExpr("o_orderkey", "o_orderstatus", f"{html} as html").select(
        "o_orderkey",
        F.when(C("o_orderstatus") == "P", C("html"))
        .otherwise(F.to_json(F.struct(F.lit(3).alias("found"), C("html"))))
        .alias("contenido_crudo"),
        F.lit("https://portal.example.org/").alias("url_base"),
    )
    rule = pages_html.HtmlRule(contenedor_items=".caja", identificador="h4", titulo="h4", descripcion="h6")
    items = pages_html.extract_html(pages_html.unwrap_ajax(rows), rule)
    return items.select("o_orderkey", "titulo", C("descripcion").alias("estado_texto"))


#: The check reads these pages by patterns: noise elements and comments are cut, then tags part the pieces.
NOISE_SQL = "|".join(rf"<{t}(?:\s[^>]*)?>.*?(?:</{t}>|$)" for t in fixed.NOISE_TAGS)
ENTITY_SQL = "x"
for _name, _char in (("copy", 169), ("middot", 183), ("nbsp", 160), ("hellip", 8230), ("mdash", 8212), ("quot", 34), ("lt", 60), ("gt", 62), ("#39", 39), ("amp", 38)):
    ENTITY_SQL = f"replace({ENTITY_SQL}, '&{_name};', chr({_char}))"
TAGS_SQL = r"""<[a-zA-Z/!](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""


@query(
    "clean_pages",
    rf"""with cut as (select page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '<x>', 'gs'), '{NOISE_SQL}', '<x>', 'gsi') as h from pages),
        pieces as (select page_id, url, list_transform(regexp_split_to_array(h, '{TAGS_SQL}'), lambda x: trim({ENTITY_SQL}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as p from cut)
        select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(p, lambda x: x <> ''), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')) as texto from pieces""",
)
def clean_pages(spark, d):
    """Text of the whole pages."""
    return pages_html.clean_pages(spread(read(spark, d, "pages"))).select("page_id", "url", "texto")


@query(
    "page_links",
    rf"""with cut as (select page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<(?:script|style)(?:\s[^>]*)?>.*?(?:</(?:script|style)>|$)', '', 'gsi') as h from pages),
        found as (select page_id, unnest(regexp_extract_all(h, '<a\s[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 's')) as a, generate_subscripts(regexp_extract_all(h, '<a\s[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 's'), 1) - 1 as pos from cut),
        read as (select page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) as x, array_to_string(list_transform(regexp_split_to_array(a, '{TAGS_SQL}'), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(13))), '') as t from found),
        named as (select page_id, pos, {ENTITY_SQL} as href, t as x from read)
        select page_id, cast(pos as int) as pos, href, nullif({ENTITY_SQL}, '') as texto from named where href <> ''""",
)
def page_links(spark, d):
    """Every link of the whole pages, with its text."""
    return pages_html.page_links(spread(read(spark, d, "pages"))).select("page_id", "pos", "href", "texto")


# --- JSON ---------------------------------------------------------------------
JSON_ITEM = f"""'{{"codBp":' || case when n = 2 and o_orderstatus = 'P' then 'null' else '"' || {KEY} || '-' || {N} || '"' end || ',"nombre":{{"rendered":" Fondo ' || {KEY} || ' "}},"id":' || {KEY}
    || ',"status":"' || case n when 1 then 'publish' when 2 then 'Cerrada' else '' end || '","tags":["a","t' || {N} || '"],"fechaInicio":"2026-01-0' || {N} || 'T00:00:00"}}'"""


def _json(spark, d) -> DataFrame:
    body = f"""case when o_orderpriority = '5-LOW' then '{{"datos": 3}}' when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then '{{"datos": ['
        else '{{"datos": [' || array_join(transform(sequence(1, 3), n -> {JSON_ITEM}), ', ') || ']}}' end"""
    rows = spread(read(spark, d, "orders")).selectExpr("o_orderkey as snapshot_id", f"{body} as contenido_crudo")
    mapping = json_items.JsonMapping(
        root_path="datos", identificador="codBp", titulo="nombre.rendered", estado="status", descripcion="tags.1",
        fecha_apertura="fechaInicio", monto="id", region="nada.x",
    )
    return json_items.extract_json(rows, mapping)


_REASON = """case when o_orderpriority = '5-LOW' then 'raiz_no_es_lista' when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'json_invalido'
    when o_orderstatus = 'P' then 'item_incompleto' end"""


@query(
    "extract_json",
    f"""select o_orderkey as snapshot_id, cast(n - 1 as int) as pos, {KEY} || '-' || n as identificador, 'Fondo ' || {KEY} as titulo, 't' || n as descripcion,
        case n when 1 then 'ABIERTO' when 2 then 'CERRADO' else 'DESCONOCIDO' end as estado, '2026-01-0' || n || 'T00:00:00' as fecha_apertura, {KEY} as monto, cast(null as varchar) as region
        from orders, unnest([1, 2, 3]) as r(n) where ({_REASON}) is null""",
)
def extract_json(spark, d):
    return json_items.explode_items(_json(spark, d)).drop("url_detalle", "grupo", "fecha_cierre")


@query("validate_capture", f"select o_orderkey as snapshot_id, {_REASON} as reject_reason from orders")
def validate_capture(spark, d):
    return _json(spark, d).select("snapshot_id", "reject_reason")


_REGION = "case month(o_orderdate) when 1 then 'Los Lagos' when 2 then 'Lagos' when 3 then 'Maule' when 4 then 'Los Ríos' when 5 then 'Ríos' when 6 then null else 'Biobío' end"
_GROUP_TITLE = "'Fondo ' || {key} || case when o_orderstatus = 'F' then ' - Región de ' || 'Maule' else ', Región de Los Ríos' end"


@query(
    "group_merge_regions",
    f"""with x as (select o_custkey as snapshot_id, case when o_orderpriority <> '5-LOW' then o_orderpriority end as grupo, o_orderkey as pos,
        {_REGION} as region, 'Fondo ' || o_orderkey as base, o_orderstatus as s from orders),
        g as (select snapshot_id, grupo, min_by(base, pos) as titulo, first(region order by pos) as r0,
        list(region order by pos) filter (region is not null) as rs from x where grupo is not null group by 1, 2)
        select snapshot_id, grupo as identificador, titulo, case when r0 is not null then list_reduce(rs, lambda a, b: case when contains(a, b) then a else a || ', ' || b end) end as region from g
        union all select snapshot_id, 'i' || s, max_by(case when s = 'F' then base || ' - Región de Maule' else base || ', Región de Los Ríos' end, pos),
        nullif(max_by(coalesce(region, '~'), pos), '~') from x where grupo is null group by 1, 2""",
)
def group_merge_regions(spark, d):
    items = read(spark, d, "orders").selectExpr(
        "o_custkey as snapshot_id", "case when o_orderpriority <> '5-LOW' then o_orderpriority end as grupo", "o_orderkey as pos",
        "'i' || o_orderstatus as identificador", _GROUP_TITLE.format(key=KEY) + " as titulo", f"{_REGION} as region",
    )
    merged = json_items.group_merge_regions(items, ["snapshot_id"])
    return merged.select("snapshot_id", "identificador", "titulo", "region")


# --- feeds --------------------------------------------------------------------
RSS_ITEM = f"""'<item><title>' || case n when 1 then 'Concurso abierto ' || {KEY} when 2 then 'Aviso ' || {KEY} else '<![CDATA[Fondo & más ' || {KEY} || ']]>' end || '</title>'
    || case when n < 3 then '<link>https://f.example.org/' || {KEY} || '/' || {N} || '</link>' else '' end
    || '<description>&lt;p&gt;Monto $' || {KEY} || '.500, hasta el 3 de mayo&lt;/p&gt;</description></item>'"""
ATOM_ITEM = f"""'<entry><title type="html">' || case n when 2 then 'Aviso ' else 'Programa vigente ' end || {KEY} || '</title><link href="https://f.example.org/' || {KEY} || '/' || {N} || '"/><summary>Cierre 0' || {N} || '/08/2026</summary></entry>'"""


@query(
    "extract_feed",
    f"""select o_orderkey, case when o_orderstatus <> 'P' and n = 3 then 'rss-' || left(md5('Fondo & más ' || {KEY}), 10) else 'https://f.example.org/' || {KEY} || '/' || n end as identificador,
        case when o_orderstatus = 'P' then case when n = 2 then 'Aviso ' else 'Programa vigente ' end || {KEY} when n = 1 then 'Concurso abierto ' || {KEY} else 'Fondo & más ' || {KEY} end as titulo,
        case when o_orderstatus = 'P' then 'Cierre 0' || n || '/08/2026' else 'Monto $' || {KEY} || '.500, hasta el 3 de mayo' end as descripcion,
        case when (o_orderstatus = 'P' and n <> 2) or n = 1 then 'ABIERTO' else 'DESCONOCIDO' end as estado,
        case when o_orderstatus = 'P' then '0' || n || '/08/2026' else '3 de mayo' end as fecha_cierre,
        case when o_orderstatus <> 'P' then '$' || {KEY} || '.500,' end as monto
        from orders, unnest([1, 2, 3]) as r(n) where o_orderpriority <> '5-LOW' and (n <> 2 or o_orderstatus = 'P')
        and not (o_orderpriority = '1-URGENT' and o_orderstatus = 'F')""",
)
def extract_feed(spark, d):
    body = f"""case when o_orderpriority = '5-LOW' then '<html><body>no</body></html>'
        when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then '<rss><channel><item>'
        when o_orderstatus = 'P' then '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>' || array_join(transform(sequence(1, 3), n -> {ATOM_ITEM}), '') || '</feed>'
        else '<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>' || array_join(transform(sequence(1, 3), n -> {RSS_ITEM}), '') || '</channel></rss>' end"""
    rows = spread(read(spark, d, "orders")).selectExpr("o_orderkey", f"{body} as contenido_crudo")
    return feeds.extract_feed(rows).drop("pos", "url_detalle")


# --- model responses ----------------------------------------------------------
RESPONSE_ITEM = f"""'{{"identificador": "' || {KEY} || '-' || {N} || '", "titulo": " T' || {N} || ' ", "estado": "' || case o_orderstatus when 'O' then 'abierto' when 'F' then 'Cerrada hoy' else 'nada' end || '", "monto": ' || {KEY} || '}}'"""
RESPONSE = f"""case o_orderpriority when '1-URGENT' then '{{"items": [' || array_join(transform(sequence(1, 2), n -> {RESPONSE_ITEM}), ', ') || ', 7]}}'
    when '2-HIGH' then 'Claro:' || chr(10) || '```json' || chr(10) || '[' || array_join(transform(sequence(1, 2), n -> {RESPONSE_ITEM}), ', ') || ']' || chr(10) || '```' || chr(10) || 'Listo.'
    when '3-MEDIUM' then 'Encontré esto: {{"resultado": "ok", "lista": [' || array_join(transform(sequence(1, 2), n -> {RESPONSE_ITEM}), ', ') || ']}} y nada más'
    when '4-NOT SPECIFIED' then '[1] ver {{"data": [' || array_join(transform(sequence(1, 2), n -> {RESPONSE_ITEM}), ', ') || ']}}'
    else 'No encontré convocatorias.' end"""


def _responses(spark, d) -> DataFrame:
    return spread(read(spark, d, "orders")).selectExpr("o_orderkey as response_id", f"{RESPONSE} as text")


@query(
    "recover_json",
    """select o_orderkey as response_id, case o_orderpriority when '1-URGENT' then 'OBJECT' when '2-HIGH' then 'ARRAY' when '3-MEDIUM' then 'OBJECT'
        when '4-NOT SPECIFIED' then 'OBJECT' end as tipo from orders""",
)
def recover_json(spark, d):
    value = responses.recover_json(C("text"))
    kind = F.regexp_extract(F.schema_of_variant(value), "^(ARRAY|OBJECT)", 1)
    return _responses(spark, d).select("response_id", F.nullif(kind, F.lit("")).alias("tipo"))


_WITH_ITEMS = "from orders, unnest([1, 2]) as r(n) where o_orderpriority <> '5-LOW'"


@query(
    "recover_items",
    f"select o_orderkey as response_id, cast(n - 1 as int) as pos, {KEY} || '-' || n as identificador {_WITH_ITEMS}",
)
def recover_items(spark, d):
    return responses.recover_items(_responses(spark, d)).select(
        "response_id", "pos", F.try_variant_get("item", "$.identificador", "string").alias("identificador")
    )


@query(
    "responses_to_items",
    f"""select o_orderkey as response_id, {KEY} || '-' || n as identificador, 'T' || n as titulo, cast(null as varchar) as descripcion,
        case o_orderstatus when 'O' then 'ABIERTO' when 'F' then 'CERRADO' else 'DESCONOCIDO' end as estado, {KEY} as monto {_WITH_ITEMS}""",
)
def responses_to_items(spark, d):
    rows = responses.responses_to_items(responses.recover_items(_responses(spark, d)))
    return rows.select("response_id", "identificador", "titulo", "descripcion", "estado", "monto")


@query(
    "pack_context",
    f"""with f as (select conv_id, turn, text as t, length(text) as n from conversations where text <> ''),
        s as (select *, coalesce(sum(n) over w, 0) as k, row_number() over (partition by conv_id order by turn) - 1 as i from f
        window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
        o as (select *, max(case when k + greatest(i - 1, 0) * 7 + n > {fixed.CONTEXT_CHARS} then 1 else 0 end) over (partition by conv_id order by turn) as stop from s),
        p as (select conv_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as contexto, count(*) as fragmentos from o where stop = 0 group by 1)
        select c.conv_id, coalesce(contexto, left(texto, {fixed.CONTEXT_CHARS})) as contexto, coalesce(fragmentos, 0) as fragmentos
        from (select conv_id, coalesce(string_agg(text, chr(10) order by turn), '') as texto from conversations group by 1) c left join p using (conv_id)""",
)
def pack_context(spark, d):
    turns = read(spark, d, "conversations")
    fragments = turns.select("conv_id", C("turn").alias("pos"), C("text").alias("fragmento"))
    in_order = F.array_sort(F.collect_list(F.struct("turn", "text")))
    texts = F.transform(in_order, lambda t: t.text)
    whole = turns.groupBy("conv_id").agg(F.array_join(texts, "\n").alias("texto"))
    return responses.pack_context(fragments, ["conv_id"], whole)
