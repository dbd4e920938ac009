"""Notifications: which events, to which channels, with which text and result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.functions.amounts import amount_text
from atalaya.functions.text import stable_key

#: Channels in one array value.
CHANNEL_BLOCK = 10_000


def notifiable_events(events: DataFrame, new_calls: DataFrame) -> DataFrame:
    """Relevant events with the call they speak of."""
    calls = new_calls.withColumnRenamed("id", "convocatoria_id").drop(
        "fuente_id", "identificador_externo"
    )
    return events.where("es_relevante").join(calls, "convocatoria_id")


def _default(c: Column, text: str) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(text))


def _timestamp(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def render_messages(events: DataFrame) -> DataFrame:
    """Outbox texts: chat HTML, mail subject and body, log line.

    Rows carry ``tipo, deltas, titulo, estado, url_detalle, monto,
    fecha_cierre, fuente_nombre``.
    """
    opening = F.col("tipo") == "APERTURA"
    title, name, url = F.col("titulo"), F.col("fuente_nombre"), _default(F.col("url_detalle"), "None")
    closing = F.coalesce(_timestamp(F.col("fecha_cierre")), F.lit("No definido"))
    quoted = F.transform(
        "deltas",
        lambda d: F.concat(
            d.campo, F.lit(": '"), _default(d.valor_anterior, "None"),
            F.lit("' -> '"), _default(d.valor_nuevo, "None"), F.lit("'"),
        ),
    )
    struck = F.transform(
        "deltas",
        lambda d: F.concat(
            F.lit("• <b>"), d.campo, F.lit(":</b> <strike>"), _default(d.valor_anterior, "N/A"),
            F.lit("</strike> → "), _default(d.valor_nuevo, "N/A"),
        ),
    )
    chat_open = F.concat(
        F.lit("<b>🆕 NUEVA CONVOCATORIA</b>\n🏛 <i>"), name, F.lit("</i>\n\n<b>"), title,
        F.lit("</b>\n\n💰 Monto: "), amount_text(F.col("monto")), F.lit("\n📅 Cierre: "),
        F.coalesce(F.date_format("fecha_cierre", "dd/MM/yyyy"), F.lit("No definido")),
    )
    chat_change = F.concat(
        F.lit("<b>⚠️ CAMBIO DETECTADO</b>\n🏛 <i>"), name, F.lit("</i>\n\n<b>"), title,
        F.lit("</b>\n\n"), F.array_join(struck, "\n"),
    )
    chat = F.concat(
        F.when(opening, chat_open).otherwise(chat_change),
        F.lit("\n\n🔗 <a href='"), url, F.lit("'>Ver detalle en el portal</a>"),
    )
    mail_open = F.concat(
        F.lit("NUEVA CONVOCATORIA DETECTADA\n---------------------------\nFuente: "), name,
        F.lit("\nTítulo: "), title,
        F.lit("\nMonto: "), _default(F.nullif(F.col("monto"), F.lit(0).cast("decimal(15,2)")), "No definido"),
        F.lit("\nCierre: "), closing, F.lit("\nEstado: "), F.col("estado"), F.lit("\n"),
    )
    mail_change = F.concat(
        F.lit("CAMBIO RELEVANTE DETECTADO\n--------------------------\nFuente: "), name,
        F.lit("\nTítulo: "), title, F.lit("\nCambios detectados:\n"),
        F.array_join(F.transform(quoted, lambda q: F.concat(F.lit("- "), q)), "\n"), F.lit("\n"),
    )
    mail = F.concat(
        F.when(opening, mail_open).otherwise(mail_change),
        F.lit("\nEnlace al detalle: "), url, F.lit("\n\nEste es un mensaje automático."),
    )
    log = F.when(
        opening,
        F.concat(
            F.lit("NUEVA CONVOCATORIA en "), name, F.lit("\nTítulo: "), title,
            F.lit("\nEstado: "), F.col("estado"), F.lit("\nURL: "), url, F.lit("\nCierre: "), closing,
        ),
    ).otherwise(
        F.concat(
            F.lit("CAMBIO RELEVANTE en "), name, F.lit("\nTítulo: "), title,
            F.lit("\nCambios: "), F.array_join(quoted, ", "), F.lit("\nURL: "), url,
        )
    )
    return events.withColumns(
        {
            "mensaje_chat": chat,
            "asunto": F.concat(F.col("tipo"), F.lit(" en "), name),
            "mensaje_correo": mail,
            "mensaje_log": log,
        }
    )


def channel_configs(stored: DataFrame, added: DataFrame, created_at: Column) -> DataFrame:
    """Channel settings with new rows appended, settings as a variant."""
    new = added.select(
        stable_key(F.col("nombre"), F.col("tipo")).alias("id"),
        "nombre",
        "tipo",
        F.try_parse_json("configuracion").alias("configuracion"),
        "activa",
        created_at.alias("creado_en"),
    )
    return stored.unionByName(new) if stored is not None else new


def _setting(name: str) -> Column:
    return F.try_variant_get("configuracion", f"$.{name}", "string")


def active_channels(channels: DataFrame) -> DataFrame:
    """Active channels in order, with their recipient (NULL = not configured).

    A chat channel needs a token and a chat id; mail needs a host and
    recipients; the log is always ready.
    """
    chat = F.when(
        (_setting("token") != "") & (_setting("chat_id") != ""), _setting("chat_id")
    )
    mail_to = F.array_join(
        F.try_variant_get("configuracion", "$.target_emails", "array<string>"), ", "
    )
    mail = F.when((_setting("host") != "") & (mail_to != ""), mail_to)
    return channels.where("activa").select(
        "pos",
        F.col("tipo").alias("canal"),
        F.when(F.col("tipo") == "TELEGRAM", chat)
        .when(F.col("tipo") == "EMAIL", mail)
        .when(F.col("tipo") == "LOGGER", "structlog")
        .alias("destinatario"),
    )


def notification_fanout(events: DataFrame, channels: DataFrame) -> DataFrame:
    """One outbox row per event and active channel.

    The channel settings travel as one array value next to each event (a
    scalar subquery) and are exploded there: no join, no shuffle of events.
    More than CHANNEL_BLOCK channels are dealt over blocks of about that many,
    and events meet each block by a join on its number.
    """
    active = active_channels(channels)
    blocks = -(-active.count() // CHANNEL_BLOCK)
    gathered = F.sort_array(F.collect_list(F.struct("pos", "canal", "destinatario")))
    if blocks <= 1:
        rows = events.withColumn("c", F.explode(active.agg(gathered).scalar()))
    else:
        listed = active.groupBy(F.pmod(F.xxhash64("pos"), F.lit(blocks)).alias("_bloque")).agg(gathered.alias("_canales"))
        dealt = events.withColumn("_bloque", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        rows = dealt.join(listed, "_bloque").withColumn("c", F.explode("_canales"))
    relevant, ready = F.col("es_relevante"), F.col("c.destinatario").isNotNull()
    return rows.select(
        *events.columns,
        F.col("c.pos").alias("pos"),
        F.col("c.canal").alias("canal"),
        F.coalesce(F.col("c.destinatario"), F.lit("no_configurado")).alias("destinatario"),
        F.when(relevant & ready, "PENDIENTE").otherwise("SKIPPED").alias("estado_envio"),
        F.when(~ready & (F.col("c.canal") == "TELEGRAM"), "bot_token o chat_id no configurados")
        .when(~ready & (F.col("c.canal") == "EMAIL"), "host o target_emails no configurados")
        .when(~ready, "canal desconocido")
        .when(~relevant, "evento no relevante")
        .alias("error_log"),
    )


def notification_result(attempts: DataFrame) -> DataFrame:
    """One result per event out of its channels' results.

    ``attempts``: ``evento_id, pos, canal, destinatario, estado, error_log``;
    an event no channel was registered for has one row with a NULL ``pos``.
    """
    failed = F.col("estado") == "FALLIDO"
    grouped = attempts.groupBy("evento_id").agg(
        F.bool_or(F.col("estado") == "ENVIADO").alias("sent"),
        F.bool_or(failed).alias("failed"),
        F.max_by("error_log", F.when(failed, F.col("pos"))).alias("last_error"),
        F.max_by(F.struct("canal", "destinatario", "estado", "error_log"), "pos").alias("last"),
        F.count("pos").alias("tried"),
    )
    sent, bad = F.coalesce("sent", F.lit(False)), F.coalesce("failed", F.lit(False))
    own = F.col("tried") > 0
    mixed = sent | bad

    def pick(composite: Column, last: str, none: str) -> Column:
        return F.when(mixed, composite).when(own, F.col(f"last.{last}")).otherwise(F.lit(none))

    return grouped.select(
        "evento_id",
        pick(F.lit("COMPOSITE"), "canal", "COMPOSITE").alias("canal"),
        pick(F.lit("multiples"), "destinatario", "ninguno").alias("destinatario"),
        pick(F.when(sent, "ENVIADO").otherwise("FALLIDO"), "estado", "SKIPPED").alias("estado"),
        pick(
            F.when(
                sent & bad, F.concat(F.lit("algunos canales fallaron: "), F.coalesce("last_error", F.lit("None")))
            ).when(bad, F.col("last_error")),
            "error_log",
            "no hay adaptadores registrados",
        ).alias("error_log"),
    )


def persist_notifications(results: DataFrame, history: DataFrame, sent_at: Column) -> DataFrame:
    """Result rows to append: only those whose event is in the history."""
    known = history.select(F.col("id").alias("evento_id"))
    return results.join(known, "evento_id", "left_semi").select(
        stable_key(F.col("evento_id"), F.col("canal"), F.col("destinatario")).alias("id"),
        F.col("evento_id").alias("historial_cambios_id"),
        "canal",
        "destinatario",
        sent_at.alias("enviado_en"),
        "estado",
        "error_log",
    )
