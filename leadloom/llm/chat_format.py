"""Conversations as training text with a loss mask, by Spark expressions only, and read back.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a
block, whose texts stay apart by a separator; the blocks are concatenated::

    <|im_start|>user\\nfirst text<|im_sep|>second text<|im_end|>\\n<|im_start|>assistant\\n...<|im_end|>\\n

Inside texts every ``<|``, with any backslashes between the two signs, gets one more backslash there, so no text
holds a control string, and taking one away gives the text back. Roles are escaped by percent codes.

The mask is a list of ``(start, length)`` in bytes of the UTF-8 text: one entry for the escaped text of each turn of a
trained role, and nothing else. Bytes let a reader cut a span without counting characters from the start.

A conversation of up to PIECE turns is one row. A longer one is several rows, ``piece`` 0, 1, ..., each of PIECE turns
and well-formed by itself, so a conversation of any length is collected by no single task; its turns are numbered by
ranges of their order. A block does not reach over the end of a piece.

Defined cases: a NULL text or role is empty. Turns are ordered by turn, NULL first, then role and text; repeated turns
all stay. Rows with a NULL id form one conversation with a NULL id, of any size. An empty text is a
turn with an empty span. Other columns are not read. An empty table gives no rows. :func:`digests` concatenates a
conversation, as its SHA-256 asks, so its text may not pass what a string holds (2 GB).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.places import placed
from leadloom.llm.tables import stored

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TRAINED = ("assistant",)
PIECE = 256  # turns

_TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _swap(text, pairs):
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escape_role(role: Column) -> Column:
    return _swap(role, _CODES)


def unescape_role(role: Column) -> Column:
    return _swap(role, [(b, a) for a, b in reversed(_CODES)])


def merged(turns: Column) -> Column:
    """Sorted turns as blocks ``(role, texts)``: adjacent turns of one role are one block."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def add(blocks, turn):
        end = F.element_at(blocks, -1)
        more = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(F.struct(end["role"].alias("role"), F.array_append(end["texts"], turn["text"]).alias("texts"))))
        new = F.array_append(blocks, F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        return F.when((F.size(blocks) > 0) & (F.get(blocks, F.size(blocks) - 1)["role"] == turn["role"]), more).otherwise(new).cast(kind)

    return F.aggregate(turns, F.array().cast(kind), add)


def strips(blocks: Column, trained=TRAINED) -> Column:
    """The output in order, as ``(s, loss)``: control strings, and texts with whether they are trained on."""

    def of(block):
        loss = block["role"].isin(list(trained))
        text = lambda t: F.struct(escape(t).alias("s"), loss.alias("loss"))
        plain = lambda s: F.struct(s.alias("s"), F.lit(False).alias("loss"))
        head = plain(F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")))
        rest = F.transform(F.slice(block["texts"], 2, F.size(block["texts"])), lambda t: F.array(plain(F.lit(SEPARATOR)), text(t)))
        return F.concat(F.array(head, text(block["texts"][0])), F.flatten(rest), F.array(plain(F.lit(END))))

    return F.flatten(F.transform(blocks, of))


def spans(parts: Column) -> Column:
    """``(start, length)`` in bytes of the parts that are trained on."""
    kind = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"

    def add(state, part):
        size = F.octet_length(part["s"]).cast("long")
        span = F.struct(state["at"].alias("start"), size.alias("length"))
        return F.struct((state["at"] + size).alias("at"), F.when(part["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans")).cast(kind)

    return F.aggregate(parts, F.struct(F.lit(0).cast("long"), F.array()).cast(kind), add)["spans"]


def pieces(conversations: DataFrame) -> DataFrame:
    """``(conv_id, piece, n_pieces, turns)``: the sorted turns of each piece."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sizes = rows.groupBy(F.col("conv_id").alias("_id")).agg(F.count("*").alias("_n"))
    long = stored(sizes.where(F.col("_n") > PIECE).select("_id"), "long-conversations")
    is_long = F.col("conv_id").eqNullSafe(F.col("_id"))
    short = rows.join(long, is_long, "left_anti").withColumns({"piece": F.lit(0).cast("long"), "n_pieces": F.lit(1).cast("long")})
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    numbered = placed(rows.join(long, is_long, "left_semi"), "conv_id", order, "long-turns")
    cut = numbered.withColumns({"piece": F.floor(F.col("place") / PIECE).cast("long"), "n_pieces": F.ceil(F.col("n") / PIECE).cast("long")})
    both = short.unionByName(cut.drop("place", "n"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return both.groupBy("conv_id", "piece", "n_pieces").agg(turns.alias("turns"))


def formatted(conversations: DataFrame, trained=TRAINED) -> DataFrame:
    """``(conv_id, piece, n_pieces, formatted, loss_spans)``."""
    parts = pieces(conversations).withColumn("blocks", merged(F.col("turns"))).withColumn("parts", strips(F.col("blocks"), trained))
    return parts.select(
        "conv_id", "piece", "n_pieces", F.array_join(F.col("parts.s"), "").alias("formatted"), spans(F.col("parts")).alias("loss_spans")
    )


def write(conversations: DataFrame, folder: str, trained=TRAINED):
    formatted(conversations, trained).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def parsed(text: Column) -> Column:
    """The turns ``(role, text)`` of a formatted piece, each as it went in."""

    def turns(block):
        body = F.substr(block, F.lit(len(START) + 1))
        role = unescape_role(F.substring_index(body, "\n", 1))
        texts = F.split(F.substr(body, F.locate("\n", body) + 1), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(text, r"<\|im_end\|>\n", -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns)).cast(_TURNS)


def masked(text: Column, mask: Column) -> Column:
    """The texts under the mask, as they went in."""
    raw = text.cast("binary")
    cut = lambda s: F.substr(raw, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    return F.transform(mask, lambda s: unescape(cut(s).cast("string")))


def digests(written: DataFrame) -> DataFrame:
    """A row for each conversation, from what was written."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    turns = F.col("turns")
    read_back = written.withColumn("turns", parsed(F.col("formatted"))).select(
        "conv_id", "piece", "n_pieces", F.size(turns).cast("long").alias("n_turns"), F.array_join(F.transform(turns, line), "").alias("lines"),
        F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), F.length("formatted").cast("long").alias("chars"),
    )
    values = ["n_turns", "lines", "loss", "chars"]
    single = read_back.where("n_pieces = 1").select("conv_id", *values)
    grouped = read_back.where("n_pieces > 1").groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("piece", "lines", "loss"))).alias("all"),
        F.sum("chars").alias("chars"),
    )
    joined = grouped.select("conv_id", "n_turns", *[F.array_join(F.col(f"all.{c}"), "").alias(c) for c in ("lines", "loss")], "chars")
    return single.unionByName(joined).select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )
