"""The message log's fixed schema. Unknown keys of an input fall away; missing ones are null."""

from pyspark.sql import types as T

MENTION = T.StructType([T.StructField("handle", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("real", T.BooleanType())])

MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("sender_id", T.LongType()),
        T.StructField("sender_name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("sender_username", T.StringType()),
        T.StructField("reply_to", T.LongType()),
        T.StructField("topic_id", T.LongType()),
        T.StructField("post_id", T.LongType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("media_path", T.StringType()),
        T.StructField("photo_desc", T.StringType()),
        T.StructField("media_meta", T.VariantType()),
        T.StructField("mentions", T.ArrayType(MENTION)),
        T.StructField("extra", T.VariantType()),
    ]
)

CHAT = T.StructType([T.StructField("slug", T.StringType()), T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("extra", T.VariantType())])
