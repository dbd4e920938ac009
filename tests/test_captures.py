"""Extraction from HTML, JSON, feeds and responses; paging and bundles."""

import json

from pyspark.sql import functions as F

from atalaya.operators import extract_feed as feeds
from atalaya.operators import extract_html as html
from atalaya.operators import extract_json as jsons
from atalaya.operators import registry, responses
from atalaya.sources import captures, paging, profiles, rules

C = F.col


def pages(spark, *bodies, base="https://ejemplo.com/"):
    return spark.createDataFrame([(i, base, b) for i, b in enumerate(bodies)], "page_id int, url_base string, html string")


LISTING = """<!DOCTYPE html><html><body><!-- <div class="item">no</div> --><div class="item" data-id="1"><h2 class="title">Fondo Uno</h2>
<p class="desc">Texto <b>uno</b></p><a class="link" href="/fondo/1">Ver</a><span class="status">Abierta</span>
<span class="date">Cierre: 31/12/2026</span><span class="amount">$1.000</span></div>
<div class="item" data-id="2"><h2 class="title">Fondo Dos</h2><a class="link" href="https://otro.cl/2">Ver</a></div>
<div class="item"><p>sin titulo</p></div></body></html>"""


def test_html_items(spark):
    rule = html.HtmlRule("div.item", "attr:data-id", "h2.title", "p.desc", "a.link", ".status", ".date", ".amount",
                         patrones={"fecha_cierre": r"(\d{2}/\d{2}/\d{4})"})
    rows = html.extract_html(pages(spark, LISTING), rule).orderBy("pos").collect()
    assert [(r.identificador, r.titulo, r.url_detalle, r.estado, r.fecha_cierre, r.monto) for r in rows] == [
        ("1", "Fondo Uno", "https://ejemplo.com/fondo/1", "ABIERTO", "31/12/2026", "$1.000"),
        ("2", "Fondo Dos", "https://otro.cl/2", "DESCONOCIDO", None, None),
    ]
    assert rows[0].descripcion == "Textouno"


def test_html_odd_pages(spark):
    rule = html.HtmlRule("div.item", "attr:data-id", "h2")
    odd = pages(spark, "", None, "<p>nada</p>", "<div class=item><h2>A<div class=item data-id=x><h2>B</h2></div>", "<div class='item'><h2>C &amp; <b>D</h2>")
    got = {(r.page_id, r.identificador, r.titulo) for r in html.extract_html(odd, rule).collect()}
    assert (3, "x", "B") in got and any(p == 4 and t == "C &D" for p, _, t in got)


def test_link_containers_and_whole_text(spark):
    page = """<a href="/ficha/9"><span class="badge">ABIERTO</span><h6>Fondo X</h6><div>Fin: 05-11-2026</div></a>"""
    rule = html.HtmlRule("a[href^='/ficha/']", "h6", "h6", link_detalle="attr:href", estado=".badge",
                         patrones={"fecha_cierre": r"Fin:\s*(\d{2}-\d{2}-\d{4})", "monto": r"Montos:\s*(\S+)"})
    row = html.extract_html(pages(spark, page), rule).first()
    assert (row.identificador, row.url_detalle, row.fecha_cierre, row.monto) == ("Fondo X", "https://ejemplo.com/ficha/9", "05-11-2026", None)


def test_cards_and_links(spark):
    card = '<div style="background-color:#fff"><h2>{}</h2><p>d</p><a class="btn" href="{}">x</a></div>'
    rows = spark.createDataFrame(
        [("s", 0, card.format("ab", "/es/programas/uno/") + card.format("Programa dos", "/es/programas/dos/")),
         ("s", 1, card.format("Programa uno", "/es/programas/uno/"))],
        "snapshot_id string, page_ord int, html string",
    )
    # the first card of a URL decides, and its title is too short here
    found = html.extract_cards(rows, "https://www.tarjetas.example/", ["snapshot_id"]).collect()
    assert [(r.identificador, r.titulo) for r in found] == [("dos", "Programa dos")]


def test_news_greedy_order(spark):
    item = '<div><div><div><div><div><div><a href="{}">{}</a> <span>{}</span></div></div></div></div></div></div>'
    page = (
        item.format("/sala-de-prensa/a", "Nuevo fondo municipal de barrios", "Mayo 3, 2026 y 4 de abril de 2026")
        + item.format("/sala-de-prensa/a", "Otro titulo de la misma nota", "")
        + item.format("/sala-de-prensa/b", "Nuevo fondo municipal de barrios", "")
        + item.format("/sala-de-prensa/c", "Otro titulo de la misma nota", "concurso")
    )
    rows = html.extract_news(pages(spark, page), "https://www.noticias.example/").orderBy("pos").collect()
    # the second link repeats an href, the third a title: only what was kept counts as seen
    assert [r.identificador for r in rows] == ["a", "c"]
    assert rows[0].fecha_cierre == "4 de abril de 2026"


def test_clean_pages(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='x ads'>ad</div><p>Hola  <b>mundo</b></p><script>var a='<p>'</script><footer>f</footer></body></html>"
    assert html.clean_pages(pages(spark, page)).first().texto == "Hola\nmundo"


def test_json_items(spark):
    items = [{"codBp": i, "nombre": f"N{i}", "fechaTermino": "2026-08-15T00:00:00", "region": r, "x": {"0": "cero"}, "l": ["p", "q"]}
             for i, r in enumerate(["Maule", "Biobío"])]
    bodies = [json.dumps({"datos": items}), '{"datos": {"a": 1}}', "no json", json.dumps({"datos": [*items, {"codBp": 9}]}), '{"datos": []}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "snapshot_id int, contenido_crudo string")
    mapping = jsons.JsonMapping("codBp", "nombre", "datos", fecha_cierre="fechaTermino", region="region", descripcion="x.0", monto="l.1")
    read = jsons.extract_json(rows, mapping)
    assert [r.reject_reason for r in read.orderBy("snapshot_id").collect()] == [None, "raiz_no_es_lista", "json_invalido", "item_incompleto", None]
    good = jsons.explode_items(read).orderBy("pos").collect()
    assert [(r.identificador, r.titulo, r.region, r.descripcion, r.monto) for r in good] == [("0", "N0", "Maule", "cero", "q"), ("1", "N1", "Biobío", "cero", "q")]


def test_groups(spark):
    rows = spark.createDataFrame(
        [(1, 0, "g", "a", "Fondo - Región de Maule", "Los Lagos"), (1, 1, "g", "b", "Fondo", "Lagos"), (1, 2, "g", "c", "Fondo", "Maule"),
         (1, 3, "h", "d", "Otro, Región de Arica", None), (1, 4, "h", "e", "Otro", "Maule"), (1, 5, None, "z", "Z1", "A"), (1, 6, None, "z", "Z2", "B")],
        "snapshot_id int, pos int, grupo string, identificador string, titulo string, region string",
    )
    got = {r.identificador: (r.titulo, r.region) for r in jsons.group_merge_regions(rows, ["snapshot_id"]).collect()}
    assert got == {"g": ("Fondo", "Los Lagos, Maule"), "h": ("Otro", None), "z": ("Z2", "B")}


def test_feeds(spark):
    rss = "<?xml version='1.0'?><rss version='2.0'><channel><item><title>Concurso abierto</title><link>http://a</link><description>&lt;p&gt;Hola $5&lt;/p&gt;</description></item><item><title>Clima</title><link>http://b</link></item><item><title>Fondo cerrado</title></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Programa</title><link href='http://c'/><summary>s</summary></entry></feed>"
    many = "<rss><channel>" + "".join(f"<item><title>Fondo {i}</title></item>" for i in range(60)) + "</channel></rss>"
    only_other = "<rss><channel><item><title>Clima</title></item></channel></rss>"
    bodies = [rss, atom, many, "<rss><channel>", "<html></html>", only_other]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "snapshot_id int, contenido_crudo string")
    assert [r.reject_reason for r in feeds.read_feeds(rows).orderBy("snapshot_id").collect()] == [
        None, None, None, "xml_invalido", "no_es_feed", "sin_items",
    ]
    got = feeds.extract_feed(rows).orderBy("snapshot_id", "pos").collect()
    assert [(r.titulo, r.estado, r.url_detalle) for r in got[:3]] == [
        ("Concurso abierto", "ABIERTO", "http://a"), ("Fondo cerrado", "CERRADO", None), ("Programa", "DESCONOCIDO", "http://c"),
    ]
    assert got[0].descripcion == "Hola $5" and got[0].monto == "$5" and got[1].identificador.startswith("rss-")
    assert sum(r.snapshot_id == 2 for r in got) == 60
    assert feeds.extract_feed(rows.where("snapshot_id = 2"), max_items=50).count() == 50


def test_feed_shapes(spark):
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Fondo uno</title><title>Otro fondo</title><link rel='alternate' href='http://a'/><link rel='self' href='http://b'/></entry></feed>"
    prefixed = "<?xml version='1.0'?><a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:entry><a:title>Fondo dos</a:title><a:link href='http://c'/></a:entry></a:feed>"
    channels = "<rss><channel><item><title>Fondo tres</title></item></channel><channel><title>x</title></channel><channel><item><title>Fondo cuatro</title></item></channel></rss>"
    loose = "<rss><item><title>Fondo cinco</title><link>http://e</link></item></rss>"
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([atom, prefixed, channels, loose])], "snapshot_id int, contenido_crudo string")
    got = [(r.snapshot_id, r.titulo, r.url_detalle) for r in feeds.extract_feed(rows).orderBy("snapshot_id", "pos").collect()]
    assert got == [(0, "Fondo uno", "http://a"), (1, "Fondo dos", "http://c"), (2, "Fondo tres", None), (2, "Fondo cuatro", None), (3, "Fondo cinco", "http://e")]


def test_responses(spark):
    texts = ['{"items": [{"titulo": "a"}, 3]}', '[{"titulo": "b"}]', 'x\n```json\n{"fondos": [{"titulo": "c"}]}\n```', '```\n[{"titulo": "d"}]\n```',
             'Claro: {"data": [{"titulo": "e"}]} fin', 'ver [{"titulo": "f"}] fin', "{roto", "", '{"otra": [{"titulo": "g"}]}', '{"n": [1, 2]}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "response_id int, text string")
    items = responses.responses_to_items(responses.recover_items(rows)).orderBy("response_id").collect()
    assert [(r.response_id, r.titulo) for r in items] == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (5, "f"), (8, "g")]


def test_context_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([("p", 0, "a" * 40), ("p", 1, "b" * 60), ("p", 2, "c" * 5), ("q", 0, "d" * 200)], "k string, pos int, fragmento string")
    whole = spark.createDataFrame([("p", "P"), ("q", "Q" * 150)], "k string, texto string")
    got = {r.k: (len(r.contexto), r.fragmentos) for r in responses.pack_context(rows, ["k"], whole, budget=100).collect()}
    # 40 + 60 fits, since the separator before the new fragment is not counted; then 107 + 5 does not
    assert got == {"p": (107, 2), "q": (100, 0)}


def run_pages(spark, sizes, **more):
    return spark.createDataFrame([("s", "r", i + 1, n) for i, n in enumerate(sizes)], "fuente_id string, run_id string, page int, n_items int")


def kept(df):
    return sorted(r.page for r in df.collect())


def test_paging(spark):
    assert kept(paging.consolidate_pages_short(run_pages(spark, [3, 2, 3]), 3)) == [1, 2]
    assert kept(paging.consolidate_pages_short(run_pages(spark, [3, None, 3]), 3)) == [1]
    assert kept(paging.consolidate_pages_short(run_pages(spark, [3] * 60), 3)) == list(range(1, 61))
    assert kept(paging.consolidate_pages_short(run_pages(spark, [3] * 60), 3, max_pages=50)) == list(range(1, 51))
    total = lambda sizes, n: run_pages(spark, sizes).withColumn("total_pages", F.when(C("page") == 1, F.lit(n)))
    assert kept(paging.consolidate_pages_total(total([5, 5, 5], 2))) == [1, 2]
    assert kept(paging.consolidate_pages_total(total([5, 0, 5], 3))) == [1, 2]
    assert kept(paging.consolidate_pages_total(total([5, 5], None))) == [1]
    found = lambda parts, n: spark.createDataFrame([("s", "r", i + 1, n, h) for i, h in enumerate(parts)], "fuente_id string, run_id string, page int, found int, html string")
    assert kept(paging.consolidate_pages_found(found(["a", "b", "c"], 15))) == [1, 2]
    assert kept(paging.consolidate_pages_found(found(["a", "", "c"], 0))) == [1]
    merged = paging.merge_found_pages(paging.consolidate_pages_found(found(["a", "b", "c"], 15))).first()
    assert (merged.html, merged.pages_fetched) == ("a\nb", 2)
    twice = spark.createDataFrame([("s", "r", 1, 5, "a", "2026-01-01"), ("s", "r", 1, 5, "b", "2026-01-02"), ("s", "r", 1, 5, "c", None)],
                                  "fuente_id string, run_id string, page int, found int, html string, fecha_captura string")
    assert paging.merge_found_pages(twice).first().html == "b"


def test_bundles(spark):
    rows = spark.createDataFrame([("s", 0, "uno", "<p>1\n2</p>"), ("s", 1, "dos", "x")], "s string, pos int, nombre string, html string")
    back = captures.split_bundle(captures.bundle(rows, ["s"])).orderBy("pos").collect()
    assert [(r.nombre, r.html) for r in back] == [("uno", "<p>1\n2</p>"), ("dos", "x")]


def test_rule_documents(spark):
    good = "nombre: A\nurl_busqueda: https://a.cl/\nselectores:\n  contenedor_items: div\n  identificador: a\n  titulo: b\n"
    docs = {"ok": good, "vacio": "", "lista": "- a\n- b", "yaml": "a: [1", "nombre": good.replace("nombre: A\n", ""),
            "url": good.replace("url_busqueda: https://a.cl/\n", ""), "sel": good.replace("  contenedor_items: div\n", "")}
    rows = spark.createDataFrame(list(docs.items()), "archivo string, texto string")
    got = {r.archivo: r.reject_reason for r in rules.load_rules(rows).collect()}
    assert got == {"ok": None, "vacio": "no_es_diccionario", "lista": "no_es_diccionario", "yaml": "yaml_invalido",
                   "nombre": "falta_nombre", "url": "url_invalida", "sel": "faltan_selectores"}
    assert rules.valid_rules(rules.load_rules(rows)).count() == 1


def test_bad_patterns_are_set_apart(spark):
    def doc(pattern="x", fmt="%d/%m/%Y", title="x"):
        return json.dumps({"nombre": "A", "url_busqueda": "https://a.cl/", "excluir_patrones_titulo": [title],
                           "normalizadores": {"monto": {"regex_extraction": pattern, "formato_salida": fmt}}})

    docs = {"ok": doc(r"[(]\d+"), "group": doc(r"(?<v>\d+) pesos"), "python": doc(r"(?P<v>\d+)"), "open": doc(r"(\d+"), "class": doc("[[a]"),
            "title": doc(title="(mal"), "format": doc(fmt="%Q"), "hash": doc(fmt="%d#%m#%Y")}
    read = rules.load_rules(spark.createDataFrame(list(docs.items()), "archivo string, texto string"))
    got = {r.archivo: (r.reject_reason, r.normalizadores.monto.regex_extraction) for r in read.collect() if r.normalizadores}
    assert {k: v[0] for k, v in got.items() if v[0] is None} == dict.fromkeys(["ok", "group", "python", "hash"])
    reasons = {r.archivo: r.reject_reason for r in read.collect()}
    assert (reasons["open"], reasons["class"], reasons["title"], reasons["format"]) == ("patron_invalido",) * 3 + ("formato_invalido",)
    assert got["python"][1] == r"(?<v>\d+)"


def test_json_paths_decide_per_step(spark):
    rows = spark.createDataFrame([(0, '{"d": [{"i": 1, "t": "T", "q": [{"1": "z"}]}]}')], "snapshot_id int, contenido_crudo string")
    read = jsons.extract_json(rows, jsons.JsonMapping("i", "t", "d", descripcion="q.0.1"))
    assert jsons.explode_items(read).first().descripcion == "z"


def test_profiles(spark):
    known = spark.createDataFrame([(0, "AGENCIA", ["AGENCIA_API"], "r0", "l0"), (1, "FIA", None, "r1", "l1")], "ordinal int, key string, aliases array<string>, root_url string, list_url string")
    sources = spark.createDataFrame([(1, "Agencia api!", "u", "b"), (2, "Fía", "u", "b"), (3, "F.I.A.", "u", "b")], "id int, nombre string, url_base string, url_busqueda string")
    got = {r.id: (r.perfil, r.url_base) for r in profiles.resolve_sources(sources, known).collect()}
    assert got == {1: ("AGENCIA", "r0"), 2: (None, "u"), 3: ("FIA", "r1")}


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.yaml").write_text("nombre: Ñ\nurl_busqueda: https://a.cl/\n", encoding="utf-8")
    (tmp_path / "r" / "a.txt").write_text("no")
    got = rules.load_rules(rules.read_rule_files(spark, str(tmp_path / "r"))).collect()
    assert [(r.archivo, r.nombre, r.reject_reason) for r in got] == [("a.yaml", "Ñ", None)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.html").write_text("<p>ñ</p>", encoding="utf-8")
    landed = captures.read_landed(spark, str(tmp_path / "c")).withColumn("fuente_id", F.lit("f"))
    taken = captures.ingest_snapshots(landed)
    captures.append_captures(taken, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.contenido_crudo == "<p>ñ</p>" and len(row.hash_contenido) == 64


def test_from_rule_documents_to_events(spark, tmp_path):
    from atalaya.plans.monitor import audit_rows, monitor_run

    docs = spark.createDataFrame(
        [
            ("a.yaml", "nombre: A\nurl_busqueda: https://a.cl/l\nregion_defecto: Maule\nselectores: {contenedor_items: li, identificador: 'attr:id', titulo: b, link_detalle: a, fecha_cierre: i}\nexcluir_patrones_titulo: ['^aviso']\nexcluir_patrones_url: ['/FUERA']\n"
                       "normalizadores: {fecha_cierre: {regex_extraction: 'Fin:\\s*(\\d{2}-\\d{2}-\\d{4})', formato_salida: '%d-%m-%Y'}}\n"),
            ("b.yaml", "nombre: B\nurl_busqueda: https://b.cl/l\nestrategia: json_api\njson_mapping: {root_path: datos, identificador: id, titulo: n, link_detalle: u, fecha_cierre: f}\n"),
        ],
        "archivo string, texto string",
    )
    known = rules.valid_rules(rules.load_rules(docs))
    sources = spark.createDataFrame([("1", "A", "https://a.cl/"), ("2", "B", "https://b.cl/")], "id string, nombre string, url_base string")
    caps = spark.createDataFrame(
        [("1", "s1", "<ul><li id=x><b>Fondo X</b><a href=/x>v</a><i>Fin: 31-12-2026</i><li id=y><b>Licitación pública</b><a href=/y>v</a><li id=z><b>Fondo Z</b><a href=/z>v</a><i>pronto</i><li id=w><b>Aviso W</b><a href=/w>v</a><li id=v><b>Fondo V</b><a href=/fuera/v>v</a></ul>", "https://a.cl/"),
         ("2", "s2", '{"datos": [{"id": 1, "n": "Uno", "u": "https://b.cl/1", "f": "2026-08-15T00:00:00"}, {"id": 2, "n": "Dos", "u": "https://b.cl/2", "f": "2026-01-01"}]}', "https://b.cl/")],
        "fuente_id string, snapshot_id string, contenido_crudo string, url_base string",
    )
    items = registry.extract_all(caps, registry.source_rules(sources, known)).drop("url_base")
    lists = sources.select(C("id").alias("fuente_id"), F.array(F.lit("estado")).alias("campos_sensibles"), F.array().cast("array<string>").alias("ignorar_cambios_en"))
    stored = spark.createDataFrame(
        [("old", "2", "1", "Antes", "ABIERTO")], "id string, fuente_id string, identificador_externo string, titulo string, estado string"
    )
    for name in ("descripcion", "url_detalle", "region"):
        stored = stored.withColumn(name, F.lit(None).cast("string"))
    for name in ("fecha_apertura", "fecha_cierre", "creado_en", "actualizado_en"):
        stored = stored.withColumn(name, F.lit(None).cast("timestamp_ntz"))
    stored = stored.withColumn("monto", F.lit(None).cast("decimal(15,2)"))
    run = monitor_run(items, rules.normalizer_rules(sources, known), lists, stored, "2026-06-02", ["pos"])
    got = {(r.fuente_id, r.identificador_externo): (r.tipo, r.convocatoria_id == "old") for r in run.events.collect()}
    assert got == {("1", "x"): ("APERTURA", False), ("1", "z"): ("APERTURA", False), ("2", "1"): ("MODIFICACION", True)}
    assert {(r.identificador_externo, r.motivo) for r in run.rejected.collect()} == {("y", "relevancia"), ("2", "normalizacion")}
    stored_run = monitor_run(items, rules.normalizer_rules(sources, known), lists, stored, "2026-06-02", ["pos"], stages_path=str(tmp_path / "stages"))
    for name in ("events", "calls", "rejected"):
        assert getattr(stored_run, name).exceptAll(getattr(run, name)).count() == 0 == getattr(run, name).exceptAll(getattr(stored_run, name)).count()
    assert "Scan parquet" in stored_run.rejected._jdf.queryExecution().toString() and "Arrow" not in stored_run.events._jdf.queryExecution().toString()
    assert run.calls.count() == 3 and run.kept.where("identificador_externo = 'x'").first().region == "Maule"
    assert {r.mensaje for r in audit_rows(run.rejected, "r1", "2026-06-02").collect()} == {"relevancia", "expirada"}


def test_extractor_registry(spark):
    @registry.register("propio")
    def own(rows, rule):
        return rows.select("fuente_id", F.lit(rule).alias("titulo"))

    caps = spark.createDataFrame(
        [("a", "s1", '{"d": [{"i": 1, "t": "T"}]}', "https://a.cl/"), ("b", "s2", '<div class="i"><h2>H</h2></div>', "https://b.cl/"), ("c", "s3", "", "https://c.cl/")],
        "fuente_id string, snapshot_id string, contenido_crudo string, url_base string",
    )
    items = registry.extract_all(caps, [("a", "json_api", jsons.JsonMapping("i", "t", "d")), ("b", None, html.HtmlRule("div.i", "h2", "h2")), ("c", "propio", "mio")])
    assert sorted((r.fuente_id, r.titulo) for r in items.collect()) == [("a", "T"), ("b", "H"), ("c", "mio")]


def test_rules_of_one_pass(spark):
    import pytest

    page = ("<div class='fila x'><div class=caja id=u><p title='a, b'>uno<b>1</b></p><a href=' /v '>v</a></div></div>"
            "<div class=caja><p title='a, b'>fuera</p></div><div class=caja>nada</div>")
    doc = {"selectores": {"contenedor_items": "div.caja", "identificador": "attr:id", "titulo": ".fila p[title='a, b'], p[title^=zz]", "link_detalle": "a"}}
    bad = {"selectores": {"contenedor_items": "div", "identificador": "a", "titulo": "p::before"}}
    rule_rows = [("1", "html_static", json.dumps(doc)), ("2", "html_static", json.dumps(bad)), ("3", "otra", json.dumps(doc)),
                 ("5", "json_api", json.dumps({"json_mapping": {"identificador": "i", "titulo": "q.0.1"}})),
                 ("6", "html_static", json.dumps(doc | {"normalizadores": {"monto": {"regex_extraction": "(mal"}}}))]
    known = spark.createDataFrame(rule_rows, "fuente_id string, estrategia string, regla string")
    known = known.withColumns({c: F.array().cast("array<string>") for c in ("_titulos", "_partes_url")})
    bodies = [("1", page), ("1", "<div class=caja>x</div>"), ("1", None), ("2", page), ("3", page), ("4", page),
              ("5", '[{"i": 7, "q": [{"1": "z"}]}]'), ("5", '[{"i": 7}]'), ("5", "{} y"), ("5", "{}"), ("5", "NaN"), ("6", page)]
    caps = spark.createDataFrame([(f, i, "https://a.cl/", b) for i, (f, b) in enumerate(bodies)], "fuente_id string, n int, url_base string, contenido_crudo string")
    read = registry.read_by_rules(caps, known)
    assert {(r.n, r.reject_reason) for r in read.collect()} == {
        (0, None), (1, "sin_items"), (2, None), (3, "selector_invalido"), (4, "estrategia_desconocida"), (5, "sin_regla"),
        (6, None), (7, "item_incompleto"), (8, "json_invalido"), (9, "raiz_no_es_lista"), (10, "json_invalido"), (11, "patron_invalido"),
    }
    items = registry.items_by_rules(read).orderBy("n").collect()
    assert [(r.n, r.pos, r.identificador, r.titulo, r.url_detalle) for r in items] == [(0, 0, "u", "uno1", "https://a.cl/v"), (6, 0, "7", "z", None)]
    plan = registry.extract_by_rules(caps, known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # captures once, rules once
    with pytest.raises(ValueError):
        registry.extractor_for("otra")


def test_selectors_of_rule_documents(spark):
    text = "nombre: A\nurl_busqueda: https://a.cl/\nselectores: {contenedor_items: '%s', identificador: self, titulo: h2}\n"
    docs = spark.createDataFrame([("a", text % "div:hover"), ("b", text % "tr td > p.x[data-k=\"a b\"], #z")], "archivo string, texto string")
    assert {(r.archivo, r.reject_reason) for r in rules.load_rules(docs).collect()} == {("a", "selector_invalido"), ("b", None)}


def test_strategies_of_whole_sites(spark):
    known = spark.createDataFrame([("h", "subdere_homepage", "{}"), ("f", "fosis_multipage", "{}"), ("m", "llm", "{}"), ("n", "nueva", "{}")], "fuente_id string, estrategia string, regla string")
    known = known.withColumns({c: F.array().cast("array<string>") for c in ("_titulos", "_partes_url")})
    home = ('<div><a href="/sala-de-prensa/fondo-x">Nuevo fondo municipal abierto</a></div>'
            '<a href="/programas/divisi/p-1">Programa uno</a>')
    bundle = ('===PAGE:programas===\n<div style="background-color:red"><h2>Programa A</h2><a class=btn href="/programas/a/">v</a></div>\n===ENDPAGE===\n'
              '===PAGE:convocatoria-alianzas===\n<a href="/es/convocatoria-alianzas/c1">Convocatoria abierta uno</a>\n===ENDPAGE===\n')
    said = '```json\n{"items": [{"identificador": "q", "titulo": "Q"}]}\n```'
    caps = spark.createDataFrame([(f, f, "https://a.cl/", b) for f, b in (("h", home), ("f", bundle), ("m", said), ("n", home))],
                                 "fuente_id string, snapshot_id string, url_base string, contenido_crudo string")
    got = sorted((r.fuente_id, r.identificador) for r in registry.extract_all(caps, known).collect())
    assert got == [("f", "a"), ("f", "alianza-c1"), ("h", "fondo-x"), ("h", "p-1"), ("m", "q")]


def test_items_and_rejects_in_one_pass(spark):
    """Each body is read once, also where rejects are asked for."""
    captures = spark.createDataFrame(
        [(1, 7, "https://x.example.org/", "<p data-id='a'><b>Uno</b></p><p>"), (2, 8, "https://x.example.org/", "x"), (3, 7, "https://x.example.org/", "no"), (4, 7, None, "<p>")],
        "n int, fuente_id int, url_base string, contenido_crudo string",
    )
    rule = '{"selectores": {"contenedor_items": "p", "identificador": "attr:data-id", "titulo": "b"}}'
    known = spark.createDataFrame([(7, "html_static", rule, [], [])], "fuente_id int, estrategia string, regla string, _titulos array<string>, _partes_url array<string>")
    rows = registry.items_by_rules(registry.read_by_rules(captures, known), with_rejects=True)
    assert sorted(tuple(r) for r in rows.select("n", "reject_reason", "titulo", "estado").collect()) == [
        (1, None, "Uno", "DESCONOCIDO"), (2, "sin_regla", None, None), (4, "sin_items", None, None)]
    assert rows._jdf.queryExecution().analyzed().toString().count("ArrowEvalPython") + rows._jdf.queryExecution().analyzed().toString().count("_read_batch(") == 1


def test_recover_json_names_its_text_once(spark):
    """Each mention of the text in a branch would be stripped and searched again."""
    rows = spark.createDataFrame([('x ```json\n[1]\n``` y',), ('{"a": 2} and more',), ("none",), (None,)], "crudo string")
    found = rows.select(responses.recover_json(F.col("crudo")).cast("string").alias("doc"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[0].count("crudo#") == 1
    assert [r.doc for r in found.collect()] == ["[1]", '{"a":2}', None, None]
