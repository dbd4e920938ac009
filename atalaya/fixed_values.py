"""Constants whose text decides the result of a query.

They are part of the data contract of the monitored listings (canonical
statuses, Spanish month names, title patterns, marker words) and must keep
exactly this content for results to be right.
"""

# --- statuses -------------------------------------------------------------
LIVE_STATUSES = ["ABIERTO", "PROXIMAMENTE"]
CLOSED_STATUSES = ["CERRADO", "ADJUDICADO", "SUSPENDIDO", "FINALIZADO"]
UNKNOWN_STATUS = "DESCONOCIDO"

# Publication states of a blog API, mapped to a status.
POST_STATUS = {
    "publish": "ABIERTO",
    "draft": "DESCONOCIDO",
    "private": "DESCONOCIDO",
    "pending": "DESCONOCIDO",
    "trash": "CERRADO",
    "future": "PROXIMAMENTE",
}

# First pattern that is found decides.
STATUS_PATTERNS = [
    (r"\bABIERT[OA]\b", "ABIERTO"),
    (r"\bCERRAD[OA]\b", "CERRADO"),
    (r"\bPRÓ?XIMAMENTE\b", "PROXIMAMENTE"),
    (r"\bPOSTUL[AO]\b", "ABIERTO"),
    (r"\bADJUDICAD[OA]\b", "ADJUDICADO"),
    (r"\bSUSPENDID[OA]\b", "SUSPENDIDO"),
    (r"\bFINALIZAD[OA]\b", "FINALIZADO"),
    (r"\bVIGENTE\b", "ABIERTO"),
]

# --- dates ----------------------------------------------------------------
MONTHS_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
MONTHS_EN = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
LONG_DATE = r"(\d{1,2})\s+de\s+(\w+)\s+de\s*(\d{4})"
SLASH_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
DASH_DATE = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})"

# Dates and amounts looked up in free text; first pattern that is found decides.
FREE_TEXT_DATES = [
    r"(\d{1,2}\s+de\s+\w+\s+de\s+\d{4})",
    r"(\d{2}/\d{2}/\d{4})",
    r"(\d{2}-\d{2}-\d{4})",
    r"hasta\s+el\s+(\d{1,2}\s+de\s+\w+(?:\s+de\s+\d{4})?)",
    r"cierre[:\s]+(\d{1,2}\s+de\s+\w+(?:\s+de\s+\d{4})?)",
]
FREE_TEXT_AMOUNTS = [
    r"(\$[\d.,]+(?:\s*(?:CLP|UF|pesos|UFs))?)",
    r"(\d[\d.]*(?:\s*UF)s?)",
    r"(?:monto|máximo|financiamiento)[:\s]+(\$?[\d.,]+(?:\s*(?:CLP|UF))?)",
]
NEWS_DATE = (
    r"(\w+,\s+\d{1,2}\s+\w+\s+\d{4})|(\d{1,2}\s+de\s+\w+(?:\s+de\s+\d{4})?)|"
    r"(\w+\s+\d{1,2},?\s+\d{4})"
)

# --- relevance ------------------------------------------------------------
EXCLUDED_TITLES = [
    r"licitaci[óo]n\s+(p[úu]blica|abierta|cerrada|internacional|nacional)?",
    r"compra\s+(de\s+)?(maquinaria|equipo|servidor|storage|disco|hardware|software|veh[ií]culo|mobiliario|insumo)",
    r"solicitud\s+de\s+cotizaci[óo]n",
    r"cotizaci[óo]n\s+(de\s+)?(servicio|obra|suministro)",
    r"resoluci[óo]n\s+(exenta|modificatoria)?\s*(n[°oº])?\s*\d+.*(adjudica|rechaza|modifica)",
    r"acta\s+de\s+(postulaci[óo]n|admisibilidad|recepci[óo]n|apertura)",
    r"declaraci[óo]n\s+jurada",
    r"c[óo]digo\s+de\s+[ée]tica",
    r"pol[ií]tica\s+de\s+(prevenci[óo]n|delito|seguridad|privacidad)",
    r"formato\s+(tipo\s+)?(de\s+)?(recibo|documento|certificado)",
    r"vi[aá]tico",
    r"bolet[ií]n\s+de\s+ingreso",
    r"contrataci[óo]n\s+(de\s+)?(servicio|consultor[ií]a|asesor[ií]a|auditor[ií]a)",
    r"procedimiento\s+y\s+mecanismo\s+para\s+la\s+compra",
    r"listado\s+de\s+delitos",
    r"modelo\s+referencial\s+de\s+ordenanza",
]
FUNDING_SIGNALS = [
    r"fondo|fondos|financiamiento|cofinanciamiento|subsidio|subvenci[óo]n",
    r"capital\s+semilla|semilla\s+(inicia|expande|abre)|crece|innova|emprende",
    r"concurso\s+(de\s+)?(proyecto|innovaci[óo]n|emprendimiento|startup|i+d|i\+d|investigaci[óo]n)",
    r"programa\s+(de\s+)?(financiamiento|fondos|subsidio|apoyo|fomento|inversi[óo]n|desarrollo)",
    r"beca\s+(de\s+)?(investigaci[óo]n|postdoctoral|doctorado|mag[ií]ster)",
    r"proyecto\s+(de\s+)?(i\+d|i+d|innovaci[óo]n|investigaci[óo]n|emprendimiento)",
    r"convocatoria\s+(de\s+)?(fondos|financiamiento|proyecto|investigaci[óo]n|innovaci[óo]n)",
]
TITLE_YEAR = r"\b(20[0-2]\d)\b"

FEED_KEYWORDS = [
    r"convocatoria|concurso|fondo|programa|postulaci[óo]n|licitaci[óo]n",
    r"financiamiento|subvenci[óo]n|beca|proyecto|emprende|semilla",
    r"capital|crece|innova|abiert[oa]|vigente|cierre|apertura",
]
NEWS_KEYWORDS = FEED_KEYWORDS + [
    r"revive|mejoramiento|patrimonio|municipal|regional",
    r"fortalecimiento|inversi[óo]n|infraestructura|descentralizaci[óo]n",
    r"inducci[óo]n|diagn[óo]stico|contingencia",
    r"ejecuci[óo]n presupuestaria|plan regional",
]
# Widget leftovers removed from the text around a news link.
NEWS_LEFTOVERS = (
    r"(Facebook Like|Compartir en Facebook|Tweet Widget|Leer más.*?\.|"
    r"Mayo\s+\d+,\s+\d{4}|Junio\s+\d+,\s+\d{4}|"
    r"Enero|Febrero|Marzo|Abril|Julio|Agosto|Septiembre|Octubre|Noviembre|Diciembre\s+\d+,\s+\d{4})"
)
# Section pages read for the program cards end in this one of alliance links.
ALLIANCE_PAGE = "convocatoria-alianzas"
ALLIANCE_PATH = "/convocatoria-alianzas/"
ALLIANCE_INDEX = "/es/convocatoria-alianzas/"

# Id prefixes and descriptions that extractors give to items without their own.
LISTING_ID = "hash-"
FEED_ID = "rss-"
CARD_ID = "fosis-"
ALLIANCE_ID = "alianza-"
NEWS_ID = "subdere-news-"
ALLIANCE_TEXT = "Convocatoria de alianza institucional: "
FEATURED_TEXT = "Programa destacado en homepage SUBDERE: "

# --- limits ---------------------------------------------------------------
LIVENESS_MONTHS = 3
DAYS_PER_MONTH = 30
RETENTION_DAYS = 180
SHORT_PAGE_MAX_PAGES = 50
TOTAL_MAX_PAGES = 50
FOUND_MAX_PAGES = 12
FOUND_PAGE_SIZE = 10
FEED_MAX_ITEMS = 50
DESCRIPTION_CHARS = 500
FRAGMENT_CHARS = 4000
CONTEXT_CHARS = 100_000
FRAGMENT_SEPARATOR = "\n\n---\n\n"
LIST_MAX_ROWS = 200
LIST_PAGE_SIZE = 24

# --- markup ---------------------------------------------------------------
NOISE_TAGS = [
    "script", "style", "nav", "footer", "iframe", "svg", "head",
    "noscript", "header", "aside", "form",
]
NOISE_CLASSES = ["cookie-banner", "popup", "modal", "advertisement", "ads"]
BUNDLE_OPEN = "===PAGE:"
BUNDLE_CLOSE = "===ENDPAGE==="
NONCE_TOKEN = r'"nonce"\s*:\s*"([^"]+)"'
AJAXURL_TOKEN = r'"ajaxurl"\s*:\s*"([^"]+)"'
AJAX_DEFAULT_PATH = "/wp-admin/admin-ajax.php"

# --- responses ------------------------------------------------------------
RESPONSE_LIST_KEYS = [
    "items", "convocatorias", "fondos", "results",
    "data", "concursos", "proyectos", "entries",
]
RESPONSE_FIELDS = [
    "identificador", "titulo", "descripcion", "url_detalle",
    "estado", "fecha_cierre", "monto",
]
GROUP_TITLE_CUTS = [" - Región de ", ", Región de "]

# --- changes --------------------------------------------------------------
COMPARED_FIELDS = ["titulo", "descripcion", "url_detalle", "estado", "fecha_cierre", "monto"]

# --- quality report -------------------------------------------------------
REPORT_TITLE = "# Reporte de Calidad de Scraping (Data Quality)"
REPORT_HEADER = "| Fuente | Estrategia | Total Items | % Cierre | % Monto | % Región | % Desc |"
REPORT_RULE = "|--------|------------|-------------|----------|---------|----------|--------|"
