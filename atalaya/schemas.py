"""Stored tables. Times are UTC wall-clock; ids are text that reruns repeat."""

SCHEMAS = {
    "fuentes": (
        "id string, nombre string, url_base string, config string, activa boolean, "
        "creado_en timestamp_ntz, actualizado_en timestamp_ntz"
    ),
    "snapshots": (
        "id string, fuente_id string, fecha_captura timestamp_ntz, contenido_crudo string, "
        "hash_contenido string, estado_ejecucion string, metadatos variant"
    ),
    "convocatorias": (
        "id string, fuente_id string, identificador_externo string, titulo string, "
        "descripcion string, url_detalle string, fecha_apertura timestamp_ntz, "
        "fecha_cierre timestamp_ntz, monto decimal(15,2), region string, estado string, "
        "metadatos variant, creado_en timestamp_ntz, actualizado_en timestamp_ntz"
    ),
    "historial_cambios": (
        "id string, convocatoria_id string, snapshot_id string, fecha_deteccion timestamp_ntz, "
        "es_apertura boolean, delta string, es_relevante boolean"
    ),
    "notificaciones": (
        "id string, historial_cambios_id string, canal string, destinatario string, "
        "enviado_en timestamp_ntz, estado string, error_log string"
    ),
    "config_notificaciones": (
        "id string, nombre string, tipo string, configuracion variant, activa boolean, "
        "creado_en timestamp_ntz"
    ),
    "audit_logs": (
        "id string, fuente_id string, nivel string, modulo string, mensaje string, "
        "detalles variant, creado_en timestamp_ntz"
    ),
}
