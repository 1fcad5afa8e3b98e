"""Fixed table schemas; nothing in the package infers a schema."""

from pyspark.sql import types as T

EMAILS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("thread_id", T.StringType()),
    T.StructField("subject", T.StringType(), False),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("in_reply_to", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("sender", T.StringType(), False),
    T.StructField("recipients", T.ArrayType(T.StringType()), False),
    T.StructField("body", T.StringType(), False),
    T.StructField("is_embedded", T.BooleanType()),
])

ATTACHMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("email_id", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("mime_type", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("text_content", T.StringType()),
])

METADATA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("email_count", T.LongType()),
    T.StructField("attachments_count", T.LongType()),
    T.StructField("first_email_date", T.StringType()),
    T.StructField("last_email_date", T.StringType()),
    T.StructField("text_block_len", T.LongType()),
    T.StructField("chunk_size_original", T.LongType()),
    T.StructField("is_summarized", T.BooleanType()),
])

COLLECTION = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", METADATA),
])

# One message as it leaves the MIME step: headers decoded, bodies still apart,
# attachment bytes untouched. Dates and references stay raw text, since Spark
# expressions take it from there.
PARSED_FILES = T.ArrayType(T.StructType([
    T.StructField("part_no", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("declared_type", T.StringType()),
    T.StructField("content", T.BinaryType()),
]))

PARSED = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("thread_key", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("recipients", T.ArrayType(T.StringType())),
    T.StructField("date_header", T.StringType()),
    T.StructField("references_header", T.StringType()),
    T.StructField("in_reply_to", T.StringType()),
    T.StructField("plain", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("files", PARSED_FILES),
    T.StructField("error", T.StringType()),
])
