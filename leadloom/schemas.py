"""Fixed schemas. Nothing in the library infers types from data."""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


LEAD_TEXT = [
    "source", "business_name", "email", "phone", "address", "website", "category", "rating",
]

LEAD = T.StructType([T.StructField("lead_seq", T.LongType()), *_strings(*LEAD_TEXT)])

CARD_FIELDS = ["names", "phones", "addresses", "websites", "ratings", "categories"]

CARD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("card_pos", T.IntegerType()),
        *[T.StructField(f, T.ArrayType(T.StringType())) for f in CARD_FIELDS],
    ]
)

CONTACT_PAYLOAD = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "emails",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("value", T.StringType()),
                                    T.StructField("confidence", T.DoubleType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)

SENT_LOG = T.StructType(
    [
        *_strings("timestamp", "to_email", "business_name", "subject"),
        T.StructField("ml_score", T.DoubleType()),
        *_strings("ml_grade", "status"),
    ]
)

FEEDBACK = T.StructType(
    [T.StructField("lead_seq", T.LongType()), T.StructField("label", T.IntegerType())]
)

MESSAGE = T.ArrayType(T.StructType(_strings("subject", "body")))
