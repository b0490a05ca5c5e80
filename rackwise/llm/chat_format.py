"""Chat formatting of typed content parts: DataFrame functions only.

A message is (conv_id, turn, role, parts), a part has a kind: `text` with its text, or `image`, `audio`, `document` with a reference to
an attachment and its extent. A visitor turns each message into a row for its head, one for each part, by kind, and one for its end:
escaped text, or a placeholder. A running sum of lengths by conversation then gives every row its place, so attachments are known by
place, reference and the number of tokens their placeholder expands to, and the loss mask by spans of the assistant's texts.

Template: `<|turn|>role<|text|>parts<|end|>` for each turn. In roles and texts a backslash is doubled, and one is put behind the first
character of every control string of CONTROL, ours and those of other templates, so that none of them occurs in a formatted text but
the template's own; taking the character behind each backslash gives the text back.

Turns are in order of turn (null first), equal ones of role and a digest of their parts; repeated rows are turns of their own. Null roles, texts and
parts are empty; an unknown kind is a placeholder `<|attachment|>`; an attachment of unknown extent counts one token. Rows with a null
conv_id are one conversation. Other columns are left behind. Empty tables give empty results. A conversation is one row of the
result, so it is put together in one task and is limited to Spark's strings of 2 GB; texts may be as long as that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackwise.llm.common import stored, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED = "assistant"
KINDS = ("image", "audio", "document")
#: First characters of control strings of this and other templates: anything that begins with <|, sentence and system tags, instruction brackets.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
#: Tokens of an attachment: an image by tiles, audio by seconds, a document by pages.
TILE, TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 512
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PROBE = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    """text without control strings."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_messages(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as messages with one text part each."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.array(part).alias("parts"))


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), F.when(kind.isin(*KINDS), kind).otherwise("attachment"), F.lit("|>"))


def n_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to."""
    up = lambda c: F.ceil(c).cast("long")
    size = F.when(part["kind"] == "image", up(part["width"] / TILE) * up(part["height"] / TILE)).when(part["kind"] == "audio", up(part["seconds"] * TOKENS_A_SECOND)).when(part["kind"] == "document", part["pages"].cast("long") * TOKENS_A_PAGE)
    return F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long")


def visited(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, part_no, piece, kind, ref, n_tokens, role): head, parts and end of every message as rows, in order."""
    c = F.col
    none = F.array().cast(f"array<{PART}>")
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", none).alias("parts"))
    rows = rows.withColumn("digest", F.sha2(F.to_json("parts"), 256))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    rows = rows.select("conv_id", F.row_number().over(order).alias("turn_no"), "role", "parts")

    def visit(p: Column) -> Column:
        text = p["kind"] == "text"
        piece = F.when(p.isNull(), "").when(text, escaped(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p["kind"]))
        return F.struct(piece.alias("piece"), F.when(p.isNull(), "text").otherwise(F.coalesce(p["kind"], F.lit("attachment"))).alias("kind"), p["ref"].alias("ref"), F.when(p.isNotNull() & ~F.coalesce(text, F.lit(False)), n_tokens(p)).alias("n_tokens"))

    sign = lambda piece, kind: F.array(F.struct(piece.alias("piece"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens")))
    pieces = F.concat(sign(F.concat(F.lit(TURN), escaped(c("role")), F.lit(TEXT)), "head"), F.transform("parts", visit), sign(F.lit(END), "end"))
    return rows.select("conv_id", "turn_no", "role", F.posexplode(pieces).alias("part_no", "p")).select("conv_id", "turn_no", "part_no", "p.piece", "p.kind", "p.ref", "p.n_tokens", "role")


def formatted(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row a conversation: conv_id, formatted, n_turns, attachments (turn_no, part_no, kind, ref, at, n_tokens; `at` is the code points
    before the placeholder), n_attached (tokens of all attachments), loss (for each turn, the spans (start, length) of code points within it
    that are learned)."""
    c = F.col
    by = Window.partitionBy("conv_id").orderBy("turn_no", "part_no")
    size = F.length("piece").cast("long")
    before = lambda w: F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = visited(messages).withColumn("at", before(by)).withColumn("start", before(Window.partitionBy("conv_id", "turn_no").orderBy("part_no")))
    own = (c("kind") == "text") & (c("role") == learned)
    each = F.struct("turn_no", "part_no", "piece", "kind", "ref", "at", "n_tokens", F.when(own, F.struct(c("start").cast("int").alias("start"), size.cast("int").alias("length"))).alias("span"))
    turns = rows.groupBy("conv_id", "turn_no").agg(F.array_sort(F.collect_list(F.struct("part_no", each.alias("x")))).alias("all"))
    turn = turns.select(
        "conv_id", "turn_no", F.array_join(F.transform("all", lambda v: v["x"]["piece"]), "").alias("piece"), F.transform(F.filter("all", lambda v: v["x"]["span"].isNotNull()), lambda v: v["x"]["span"]).alias("spans"),
        F.transform(F.filter("all", lambda v: v["x"]["n_tokens"].isNotNull()), lambda v: F.struct(*[v["x"][n].alias(n) for n in ("turn_no", "part_no", "kind", "ref", "at", "n_tokens")])).alias("attached"),
    )
    whole = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "piece", "spans", "attached"))).alias("all"))
    attached = F.flatten("all.attached")
    return whole.select(
        "conv_id", F.array_join("all.piece", "").alias("formatted"), F.size("all").cast("long").alias("n_turns"), attached.alias("attachments"), F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("n_attached"), c("all.spans").alias("loss")
    )


def turns_of(text: Column) -> Column:
    """The formatted turns of a conversation, each without its TURN."""
    found = F.split(text, r"<\|turn\|>")
    return F.slice(found, F.lit(2), F.size(found))


def role_of(turn: Column) -> Column:
    return unescaped(F.substring_index(turn, TEXT, 1))


def text_of(turn: Column) -> Column:
    """A turn's texts; its attachments are left out."""
    return unescaped(F.regexp_replace(turn, r"(?s)^.*?<\|text\|>|<\|(?:image|audio|document|attachment|end)\|>", ""))


def read_back(output: DataFrame) -> DataFrame:
    """(conv_id, turns (role, text), learned), from formatted and loss alone."""
    both = F.arrays_zip(turns_of(F.col("formatted")).alias("turn"), F.col("loss").alias("spans"))
    # Spans count from the TURN in front of a turn; substrings count from 1.
    learned = F.flatten(F.transform(both, lambda x: F.transform(x["spans"], lambda s: unescaped(x["turn"].substr(s["start"] - len(TURN) + 1, s["length"])))))
    turns = F.transform(turns_of(F.col("formatted")), lambda t: F.struct(role_of(t).alias("role"), text_of(t).alias("text")))
    return output.select("conv_id", turns.alias("turns"), F.array_join(learned, "").alias("learned"), "formatted")


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -1, whose two turns are control strings."""
    turns = F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.unionByName(conversations.sparkSession.range(1).select(turns))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = stored(formatted(text_messages(with_probe(table(spark, sf_dir, "conversations")))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(output)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
