"""Chat imports: question and answer pairs, message notes, Markdown and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import slugify, truncate_at_word

#: Openings that a question's title loses, in this order, each as often as it comes.
OPENINGS = ("Can you ", "Could you ", "Please ", "I want to ", "I'd like to ", "Help me ")
LEAST_QUESTION, LEAST_ANSWER = 10, 20


def in_turn() -> Window:
    return Window.partitionBy("conversation_id").orderBy("message_index")


def paired(messages: DataFrame) -> DataFrame:
    """Turns that aren't the system's, with the turn before: an assistant's answers a human's that is right before it."""
    spoken = messages.filter("role <> 'system'")
    return spoken.withColumns({"before_role": F.lag("role").over(in_turn()), "before_content": F.lag("content").over(in_turn()), "next_role": F.lead("role").over(in_turn())})


def qa_pairs(messages: DataFrame) -> DataFrame:
    """Pairs long enough to keep, in bytes, numbered from 1 within a conversation."""
    pairs = paired(messages).filter("role = 'assistant' and before_role = 'human'")
    long = (F.octet_length("before_content") > LEAST_QUESTION) & (F.octet_length("content") > LEAST_ANSWER)
    kept = pairs.filter(long).withColumn("pair", F.row_number().over(in_turn()))
    return kept.select("conversation_id", "pair", "message_index", F.col("before_content").alias("question"), F.col("content").alias("answer"))


def qa_diagnostics(messages: DataFrame) -> DataFrame:
    """Per conversation: pairs, pairs too short, questions without an answer, and whether the last one is open."""
    p = paired(messages)
    pair = (F.col("role") == "assistant") & (F.col("before_role") == "human")
    long = (F.octet_length("before_content") > LEAST_QUESTION) & (F.octet_length("content") > LEAST_ANSWER)
    human = F.col("role") == "human"
    open_ = human & ~F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    return p.groupBy("conversation_id").agg(
        F.count_if(F.coalesce(pair & long, F.lit(False))).alias("pairs"),
        F.count_if(F.coalesce(pair & ~long, F.lit(False))).alias("short_pairs"),
        F.count_if(open_).alias("open_questions"),
        F.max(open_ & F.col("next_role").isNull()).alias("ends_open"),
    )


def qa_title(question: Column, number: Column) -> Column:
    line = F.split_part(question, F.lit("\n"), F.lit(1))
    for opening in OPENINGS:
        line = F.regexp_replace(line, f"^(?:{opening})+", "")
    return F.when(line == "", F.concat(F.lit("Q&A #"), number.cast("string"))).otherwise(truncate_at_word(line, 48))


def qa_notes(messages: DataFrame, chats: DataFrame) -> DataFrame:
    named = chats.select(F.col("id").alias("conversation_id"), F.col("title").alias("chat_title"))
    return qa_pairs(messages).join(named, "conversation_id").select(
        "conversation_id",
        "pair",
        qa_title(F.col("question"), F.col("pair")).alias("title"),
        F.concat(F.lit("**Question:** "), "question", F.lit("\n\n**Answer:** "), "answer").alias("content"),
        F.array(F.lit("chat-export"), F.lit("qa"), F.concat(F.lit("conversation:"), slugify(F.col("chat_title")))).alias("tags"),
    )


def summary_notes(chats: DataFrame) -> DataFrame:
    """A note for each conversation that has a summary."""
    name = display_title(F.col("title"), F.lit(None).cast("string"))
    said = chats.filter("summary is not null and summary <> ''")
    return said.select(
        F.col("id").alias("conversation_id"), F.concat(F.lit("Summary: "), name).alias("title"), F.concat(F.lit("**Conversation:** "), name, F.lit("\n\n"), "summary").alias("content"),
        F.array(F.lit("chat-export"), F.lit("summary")).alias("tags"),
    )


def signals(messages: DataFrame) -> DataFrame:
    """Adds counts of structured blocks, tool blocks, citations and files, where the columns are there."""
    if "content_blocks" not in messages.columns:
        return messages.withColumns({c: F.lit(0) for c in ("n_blocks", "n_tools", "n_citations", "n_files")})
    kinds = F.transform("content_blocks", lambda b: b["type"])
    return messages.withColumns({
        "n_blocks": F.coalesce(F.size("content_blocks"), F.lit(0)),
        "n_tools": F.coalesce(F.size(F.filter(kinds, lambda k: k.isin("tool_use", "tool_result", "token_budget"))), F.lit(0)),
        "n_citations": F.coalesce(F.aggregate("content_blocks", F.lit(0), lambda n, b: n + F.coalesce(F.size(b["citations"]), F.lit(0))), F.lit(0)),
        "n_files": F.coalesce(F.size("files"), F.lit(0)),
    })


def message_notes(messages: DataFrame, chats: DataFrame) -> DataFrame:
    named = chats.select(F.col("id").alias("conversation_id"), F.col("title").alias("chat_title"))
    label = F.initcap("role")
    body = F.when(F.trim("content") == "", F.lit("[No text body. See structured content metadata below.]")).otherwise(F.col("content"))
    header = [
        ("Conversation", F.col("chat_title")),
        ("Message #", (F.col("message_index") + 1).cast("string")),
        ("Role", label),
        ("Created At", F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit("unknown"))),
        ("Structured Blocks", F.format_string("%d (tools: %d, citations: %d)", "n_blocks", "n_tools", "n_citations")),
        ("Files", F.when(F.col("n_files") == 0, "(none)").otherwise(F.col("n_files").cast("string"))),
    ]
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"**{name}:** "), value) for name, value in header])
    flags = [F.when(F.col(c) > 0, tag) for c, tag in (("n_tools", "tooling"), ("n_files", "has-files"), ("n_citations", "has-citations"))]
    tags = F.array_compact(F.array(F.lit("chat-export"), F.lit("message"), F.concat(F.lit("role:"), F.lower("role")), F.concat(F.lit("conversation:"), slugify(F.col("chat_title"))), *flags))
    return signals(messages).join(named, "conversation_id").select(
        "id", "conversation_id", F.concat(label, F.lit(" message #"), (F.col("message_index") + 1).cast("string")).alias("title"), F.concat(lines, F.lit("\n\n"), body).alias("content"), tags.alias("tags")
    )


def unpaired_messages(messages: DataFrame) -> DataFrame:
    """What a hybrid import keeps beside its pairs."""
    p = paired(messages)
    answered = (F.col("role") == "human") & (F.col("next_role") == "assistant")
    answers = (F.col("role") == "assistant") & (F.col("before_role") == "human")
    return p.filter(~F.coalesce(answered | answers, F.lit(False))).select(*messages.columns)


def text_to_embed(content: Column, blocks: Column | None = None) -> Column:
    """Content, else the texts of its blocks, else a placeholder."""
    joined = F.nullif(F.trim(F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: F.trim(t) != ""), "\n")), F.lit("")) if blocks is not None else F.lit(None)
    return F.coalesce(F.when(F.trim(content) != "", content), joined, F.lit("[empty message]"))


def display_title(name: Column, first_line: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.substring(first_line, 1, 50), F.lit("")), F.lit("Untitled Conversation"))


def markdown(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """A conversation as one Markdown text."""
    turn = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "content")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message_index", turn.alias("t")))), lambda x: x["t"]), "\n\n")
    texts = messages.groupBy("conversation_id").agg(body.alias("body"))
    named = chats.select(F.col("id").alias("conversation_id"), "title")
    return texts.join(named, "conversation_id").select("conversation_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("markdown"))


def preview(messages: DataFrame) -> DataFrame:
    """Counts of what an import would make."""
    d = qa_diagnostics(messages)
    totals = messages.agg(F.count("*").alias("messages"), F.count_distinct("conversation_id").alias("conversations"), F.count_if(F.octet_length("content") > LEAST_ANSWER).alias("long_messages"))
    return totals.join(d.agg(F.sum("pairs").alias("pairs"), F.sum("short_pairs").alias("short_pairs"), F.count_if(F.col("pairs") == 0).alias("chats_without_pairs"), F.count_if("ends_open").alias("chats_left_open")))


def imported_notes(messages: DataFrame, chats: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Notes of an import: pairs (qa), every message (message), or pairs and what they leave (hybrid).

    A conversation without any pair comes as one Markdown note in qa mode.
    """
    single = message_notes(messages, chats).select("conversation_id", F.lit("message").alias("kind"), "title", "content", "tags")
    if mode == "message":
        return single
    pairs = qa_notes(messages, chats).select("conversation_id", F.lit("qa").alias("kind"), "title", "content", "tags")
    if mode == "qa":
        lone = chats.join(pairs.select(F.col("conversation_id").alias("id")), "id", "left_anti").select("id", "title")
        whole = markdown(messages, chats).join(lone, F.col("conversation_id") == F.col("id"), "inner")
        return pairs.unionByName(whole.select("conversation_id", F.lit("markdown").alias("kind"), "title", F.col("markdown").alias("content"), F.array(F.lit("chat-export")).alias("tags")))
    rest = message_notes(unpaired_messages(messages), chats).select("conversation_id", F.lit("message").alias("kind"), "title", "content", "tags")
    return pairs.unionByName(rest)


def not_linked(chats: DataFrame, links: DataFrame) -> DataFrame:
    """Chats that no note comes from yet: what a second import takes."""
    return chats.join(links.select(F.col("conversation_id").alias("id")), "id", "left_anti")
