"""Inbound messages in one form, and the items to check in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of a raw message that are read.
_MEDIA = "STRUCT<file_id: STRING, file_unique_id: STRING, mime_type: STRING, file_size: BIGINT, duration: INT, width: INT, height: INT>"
_STICKER = "STRUCT<file_id: STRING, file_unique_id: STRING, file_size: BIGINT, width: INT, height: INT, is_animated: BOOLEAN, is_video: BOOLEAN>"
_CHAT = "STRUCT<id: BIGINT, type: STRING>"
_BODY = f"message_id: BIGINT, chat: {_CHAT}, `from`: STRUCT<id: BIGINT>, text: STRING, photo: ARRAY<{_MEDIA}>, animation: {_MEDIA}, sticker: {_STICKER}"


def content(m: Column) -> Column:
    """The media of a message: its largest (last) photo, else animation, else sticker; null if it has none of these."""
    largest = F.try_element_at(m["photo"], F.lit(-1))

    def media(source: Column, kind: Column, mime: Column, duration: Column) -> Column:
        return F.struct(source["file_id"].alias("file_id"), source["file_unique_id"].alias("file_unique_id"), kind.alias("type"), mime.alias("mime_type"), source["file_size"].alias("size_bytes"), duration.alias("duration_sec"), source["width"].alias("width"), source["height"].alias("height"))

    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    sticker = F.when(F.coalesce(m["sticker"]["is_animated"], F.lit(False)), "sticker_animated").otherwise("sticker_static")
    return (
        F.when(largest.isNotNull(), media(largest, F.lit("photo"), none_s, none_i))
        .when(m["animation"].isNotNull(), media(m["animation"], F.lit("animation"), m["animation"]["mime_type"], m["animation"]["duration"]))
        .when(m["sticker"].isNotNull(), media(m["sticker"], sticker, none_s, none_i))
    )


def command(text: Column) -> Column:
    """The command at the start of a text, without slash and without the name it is addressed to; null if there is none."""
    found = F.regexp_extract(text, r"^/([A-Za-z0-9_]+)", 1)
    return F.when(found != "", found)


def normalized(raw: DataFrame, json: str = "json") -> DataFrame:
    """``raw`` with id, chat_id, chat_type, sender_id, command, content and reply_to; a reply without a chat has its parent's.

    Texts that are no JSON give null in all of them. Videos and documents are no content.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in (("message_id", "BIGINT"), ("chat", _CHAT), ("`from`", "STRUCT<id: BIGINT>"), ("text", "STRING"), ("photo", f"ARRAY<{_MEDIA}>"), ("animation", _MEDIA), ("sticker", _STICKER), ("reply_to_message", f"STRUCT<{_BODY}>")))
    d = raw.withColumn("_m", F.from_json(json, schema))
    m, r = F.col("_m"), F.col("_m.reply_to_message")
    reply = F.when(r.isNotNull(), F.struct(r["message_id"].alias("id"), F.coalesce(r["chat"]["id"], m["chat"]["id"]).alias("chat_id"), F.coalesce(r["chat"]["type"], m["chat"]["type"]).alias("chat_type"), r["from"]["id"].alias("sender_id"), command(r["text"]).alias("command"), content(r).alias("content")))
    return d.withColumns({"id": m["message_id"], "chat_id": m["chat"]["id"], "chat_type": m["chat"]["type"], "sender_id": m["from"]["id"], "command": command(m["text"]), "content": content(m), "reply_to": reply}).drop("_m")


def targets(messages: DataFrame) -> DataFrame:
    """(message_id, chat_id, file_unique_id, media_type): what is checked in a message, its own content and its reply's."""
    own = F.struct(F.col("id").alias("message_id"), F.col("chat_id").alias("chat_id"), F.col("content").alias("content"))
    reply = F.struct(F.col("reply_to.id").alias("message_id"), F.col("reply_to.chat_id").alias("chat_id"), F.col("reply_to.content").alias("content"))
    t = messages.select(F.explode(F.array(own, reply)).alias("t")).filter("t.content is not null")
    return t.select("t.message_id", "t.chat_id", "t.content.file_unique_id", F.col("t.content.type").alias("media_type"))


def can_download(content_: Column) -> Column:
    """Whether a message's content names a file."""
    return F.coalesce(content_["file_id"] != "", F.lit(False))


def is_zero(content_: Column) -> Column:
    """Whether there is no content at all: no file, no unique id, no kind."""
    empty = lambda c: F.coalesce(content_[c] == "", F.lit(True))
    return content_.isNull() | (empty("file_id") & empty("file_unique_id") & empty("type"))


def is_command(command_: Column | str, name: str | None = None) -> Column:
    """Whether a message is a command, or the one called ``name``."""
    c = F.col(command_) if isinstance(command_, str) else command_
    return F.coalesce(c == name if name is not None else c != "", F.lit(False))


def is_private(chat_type: Column | str) -> Column:
    return F.coalesce((F.col(chat_type) if isinstance(chat_type, str) else chat_type) == "private", F.lit(False))


def updates(spark, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw messages (json) as they arrive in ``folder``, a file of lines each; at most so many files are taken at a time."""
    return spark.readStream.schema("value STRING").option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumnRenamed("value", "json")
