"""Prompts, the model stage, and the parsing of its replies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpuslens import config
from corpuslens.functions import replies
from corpuslens.functions.paths import filename
from corpuslens.functions.text import WORD, strip
from corpuslens.operators.skew import lookup_join

# A provider is a factory run once per task; what it makes takes a batch of prompts and a timeout in
# seconds and gives one reply per prompt. An exception object in place of a reply fails that prompt.
Client = Callable[[Sequence[str], float], Sequence[object]]
Provider = Callable[[], Client]

RESPONSE_TYPE = StructType(
    [StructField(name, StringType()) for name in ("prompt_hash", "response", "error")] + [StructField("attempts", IntegerType())]
)
#: Replies handed back to Spark at once: so many, or fewer of so many letters together.
FRAME_ROWS, FRAME_LETTERS = 2000, 1 << 20
#: Estimated tokens that go out with one call.
BATCH_TOKENS = 16 * config.DEFAULT_CONTEXT_LENGTH


def add_prompts(chunks: DataFrame, functions: bool = True, dependencies: bool = True) -> DataFrame:
    """``prompt`` and ``prompt_hash`` per chunk; equal text under equal names asks only once."""
    wanted = ["what this part of the file does, in a few words", "the classes it defines"]
    keys = ["description: string", "classes: array of strings"]
    if functions:
        wanted.append("the functions and methods it defines")
        keys.append("functions: array of strings")
    if dependencies:
        wanted.append("the imports and dependencies it uses")
        keys.append("dependencies: array of strings")
    asked = "\n".join(f"{i}. {item}" for i, item in enumerate(wanted, 1))
    brief = F.when(
        F.col("structural_only"),
        F.lit("The file is large: name its classes, functions and imports, and describe in one sentence.\n"),
    ).otherwise(F.lit(""))
    prompt = F.concat(
        F.lit("Study this part of a source file.\nFile: "),
        filename(F.col("rel_path")),
        F.lit(", lines "),
        F.col("start_line").cast("string"),
        F.lit("-"),
        F.col("reported_end_line").cast("string"),
        F.lit(" of "),
        F.col("total_lines").cast("string"),
        F.lit("\n```"),
        F.col("extension"),
        F.lit("\n"),
        F.col("content"),
        F.lit("\n```\n"),
        brief,
        F.lit("Tell:\n" + asked + "\nAnswer with one JSON object with these keys:\n" + "\n".join(keys)),
        F.lit("\nEvery array holds plain strings, never key and value pairs.\n"),
    )
    return chunks.withColumn("prompt", prompt).withColumn("prompt_hash", F.sha2("prompt", 256))


def pending_prompts(
    prompts: DataFrame, responses: DataFrame | None, deal: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct prompts that no stored response answers; a stored failure is no answer. One shuffle serves
    the duplicates and the look-up.

    ``deal`` names columns made of the hash, by which the prompts are partitioned and sorted then: the shuffle that
    deals them out serves the duplicates, and what is answered is left out before.
    """
    asked = prompts.select("prompt_hash", "prompt")
    answered = None if responses is None else responses.filter("error IS NULL").select("prompt_hash")
    if deal:
        if answered is not None:
            asked = asked.join(answered, "prompt_hash", "left_anti")
        return asked.withColumns(deal).repartition(*deal).dropDuplicates([*deal, "prompt_hash"])
    asked = asked.repartition("prompt_hash").dropDuplicates(["prompt_hash"])
    return asked if answered is None else asked.join(answered, "prompt_hash", "left_anti")


def pack(rows, batch: int, batch_tokens: float):
    """Batches of ``(prompt_hash, prompt)`` in their order: at most ``batch`` prompts, and at most
    ``batch_tokens`` by estimate. A prompt that alone passes the budget goes alone."""
    part, held = [], 0
    for row in rows:
        tokens = len((row[1] or "").encode()) // config.BYTES_PER_TOKEN
        if part and (len(part) == batch or held + tokens > batch_tokens):
            yield part
            part, held = [], 0
        part.append(row)
        held += tokens
    if part:
        yield part


def infer(
    prompts: DataFrame,
    provider: Provider,
    tasks: int | None = None,
    batch: int = 16,
    tries: int = config.CALL_TRIES,
    pause: float = config.RETRY_PAUSE_SECONDS,
    timeout: float = config.CALL_TIMEOUT_SECONDS,
    batch_tokens: int = BATCH_TOKENS,
    in_flight: int = 1,
    calls_per_second: float | None = None,
    dealt: bool = False,
) -> DataFrame:
    """One response row per prompt. ``tasks`` times ``in_flight`` bounds how many clients work at once.

    A call takes at most ``batch`` prompts and ``batch_tokens`` estimated tokens. With ``in_flight`` above
    one a task has that many calls on their way, each by a client of its own, so a client never sees two at
    once. ``calls_per_second`` holds for the whole job, repeated calls included: each task has its share.

    Only timeouts are tried again; any other failure, or the last timeout, becomes the row's error. A call
    that raises is halved until the prompts at fault stand alone.
    Prompts are shuffled into ``tasks`` pieces, unless they are ``dealt`` into no more than that already.
    Write the result before reading it twice: a model may answer differently the second time.
    """
    if min(batch, batch_tokens, in_flight) < 1 or (calls_per_second is not None and calls_per_second <= 0):
        raise ValueError("batch, batch_tokens and in_flight begin at 1, calls_per_second lies above 0")
    tasks = tasks or prompts.sparkSession.sparkContext.defaultParallelism
    gap = tasks / calls_per_second if calls_per_second else 0.0
    columns = RESPONSE_TYPE.names

    def call(frames):
        import threading
        import time
        from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, TimeoutError as Late, wait
        from queue import LifoQueue

        import pandas as pd

        gate, begin = threading.Lock(), [0.0]

        def take_turn() -> None:
            if gap:
                with gate:
                    mine = begin[0] = max(begin[0] + gap, time.monotonic())
                time.sleep(max(0.0, mine - time.monotonic()))

        def ask(desk: list, texts: list[str]) -> list[object]:
            take_turn()
            client, one = desk
            called = None
            try:
                called = one.submit(client, texts, timeout)
                answers = list(called.result(timeout * len(texts)))
                if len(answers) != len(texts):
                    raise ValueError("a provider gives one reply per prompt")
                return answers
            except (TimeoutError, Late):
                if called is not None and not called.done():  # it may hang for good: the next call has another thread
                    one.shutdown(wait=False)
                    desk[1] = ThreadPoolExecutor(1)
                late = TimeoutError(f"no reply within {timeout:g} seconds")
                return [late] * len(texts)
            except Exception as failure:
                # One bad prompt must not fail its neighbours.
                half = len(texts) // 2
                return ask(desk, texts[:half]) + ask(desk, texts[half:]) if half else [failure]

        # Clients not at work, each with the thread it is called in; those in use go first, so no more are made than needed.
        idle = LifoQueue()
        desks = [[None, ThreadPoolExecutor(1)] for _ in range(in_flight)]
        for desk in desks:
            idle.put(desk)

        def work(part):
            desk = idle.get()
            if desk[0] is None:
                desk[0] = provider()
            texts, todo = [text for _, text in part], list(range(len(part)))
            answer, error, attempts = [None] * len(part), [None] * len(part), [0] * len(part)
            for attempt in range(1, tries + 1):
                again = []
                for i, got in zip(todo, ask(desk, [texts[i] for i in todo])):
                    attempts[i] = attempt
                    if isinstance(got, TimeoutError):
                        error[i] = f"{got} ({attempt} attempts)"
                        again.append(i)
                    elif isinstance(got, BaseException):
                        error[i] = str(got)
                    else:
                        answer[i], error[i] = None if got is None else str(got), None
                todo = again
                if not todo:
                    break
                if attempt < tries:
                    time.sleep(pause)
            idle.put(desk)
            return list(zip([name for name, _ in part], answer, error, attempts))

        def framed(parts):
            """Few frames of many calls: each costs as much as many rows."""
            held, letters = [], 0
            for part in parts:
                held += part
                letters += sum(len(reply or "") for _, reply, _, _ in part)
                if len(held) >= FRAME_ROWS or letters >= FRAME_LETTERS:
                    yield pd.DataFrame(held, columns=columns)
                    held, letters = [], 0
            if held:
                yield pd.DataFrame(held, columns=columns)

        def answered():
            flying = set()
            for part in pack(rows, batch, batch_tokens):
                if len(flying) == in_flight:
                    done, flying = wait(flying, return_when=FIRST_COMPLETED)
                    yield from (one.result() for one in done)
                flying.add(pool.submit(work, part))
            while flying:
                done, flying = wait(flying, return_when=FIRST_COMPLETED)
                yield from (one.result() for one in done)

        rows = (row for frame in frames for row in zip(frame["prompt_hash"], frame["prompt"]))
        pool = ThreadPoolExecutor(in_flight)
        try:
            yield from framed(answered())
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
            for _, one in desks:
                one.shutdown(wait=False)

    rows = prompts.select("prompt_hash", "prompt")
    return (rows if dealt else rows.repartition(tasks, "prompt_hash")).mapInPandas(call, RESPONSE_TYPE)


def _declared(words: str) -> str:
    """``word name`` where the word stands alone. A set of first letters is tried at each place, which is cheaper than
    all words; the look behind comes after the word: it is then rare."""
    each = words.split("|")
    rest = "|".join(f"(?<={word[0]}){word[1:]}" for word in each)
    return rf"[{''.join(sorted({word[0] for word in each}))}](?:{rest})(?<!{WORD}(?:{words})) +({WORD}+)"


# What the built-in patterns take as a class, a function and an import.
CLASS = _declared("class|interface|struct|enum")
FUNCTION = _declared("def|function|func")
IMPORT_LINE = r"(?m)^[ \t]*+((?:import|from|using|#include)[ \t].*)"


def rules_analysis(chunks: DataFrame, functions: bool = True, dependencies: bool = True) -> DataFrame:
    """The built-in provider: ``chunk_analysis`` by patterns over the chunk text, without a model or Python.

    Gives the columns ``normalise_replies`` gives, so everything behind it is shared.
    """
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(1)))
    off = F.lit(None).cast("array<string>")
    named = F.transform(found(FUNCTION), lambda f: F.concat(f, F.lit("()")))
    return chunks.select(
        *[c for c in chunks.columns if c != "content"],
        F.lit(None).cast("string").alias("error"),
        F.concat(F.lit("Lines "), F.col("start_line"), F.lit(" to "), F.col("end_line")).alias("description"),
        found(CLASS).alias("classes"),
        (named if functions else off).alias("functions"),
        (found(IMPORT_LINE) if dependencies else off).alias("dependencies"),
        F.lit("direct").alias("parse_route"),
    )


def normalise_replies(responses: DataFrame, functions: bool = True, dependencies: bool = True) -> DataFrame:
    """Adds description, classes, functions, dependencies and ``parse_route`` to ``response, error``.

    A section that was switched off is NULL; a section the reply left out is NULL; both differ from
    an empty array.
    """
    reply = F.col("response")
    steps = responses.withColumn("_direct", replies.direct_object(reply)).withColumn(
        "_raw",
        F.when(
            F.col("_direct").isNull(),
            replies.trim_fences(
                F.when(
                    replies.widest_braces(reply).isNotNull(),
                    F.coalesce(replies.fenced_object(reply), replies.widest_braces(reply)),
                )
            ),
        ),
    )
    steps = steps.withColumn("_fixed", replies.join_signatures(replies.strip_bold(F.col("_raw"))))
    for section in ("functions", "classes", "dependencies"):
        steps = steps.withColumn("_fixed", replies.join_pairs(F.col("_fixed"), section))
    steps = steps.withColumn("_fixed", replies.close_functions(F.col("_fixed")))
    steps = steps.withColumn("_fixed", replies.drop_description_colons(F.col("_fixed")))
    for section in ("functions", "classes", "dependencies"):
        steps = steps.withColumn("_fixed", replies.join_pairs(F.col("_fixed"), section))
    nothing = F.expr("array()").cast("array<string>")
    fallback = F.struct(
        F.lit(config.UNREADABLE_REPLY).alias("description"), *[nothing.alias(s) for s in replies.SECTIONS]
    )
    failed = F.struct(
        replies.error_description(F.col("error")).alias("description"),
        *[nothing.alias(s) for s in replies.SECTIONS],
    )
    steps = (
        steps.withColumn("_repaired", replies.parse(F.col("_fixed")))
        .withColumn("_plain", F.when(F.col("_repaired").isNull(), replies.parse(F.col("_raw"))))
        .withColumn(
            "parse_route",
            F.when(F.col("error").isNotNull(), "error")
            .when(F.col("_direct").isNotNull(), "direct")
            .when(F.col("_repaired").isNotNull(), "repaired")
            .when(F.col("_plain").isNotNull(), "raw")
            .otherwise("fallback"),
        )
        .withColumn(
            "_found",
            F.when(F.col("parse_route") == "error", failed)
            .when(F.col("parse_route") == "direct", replies.parse(F.col("_direct")))
            .when(F.col("parse_route") == "repaired", F.col("_repaired"))
            .when(F.col("parse_route") == "raw", F.col("_plain"))
            .otherwise(fallback),
        )
    )
    on = {"classes": True, "functions": functions, "dependencies": dependencies}
    return steps.select(
        *responses.columns,
        F.coalesce(F.col("_found.description"), F.lit(config.NO_DESCRIPTION)).alias("description"),
        *[
            (F.col(f"_found.{s}") if on[s] else F.lit(None).cast("array<string>")).alias(s)
            for s in replies.SECTIONS
        ],
        "parse_route",
    )


def add_summary_prompts(files: DataFrame, functions: bool = True, dependencies: bool = True) -> DataFrame:
    """Summary prompt of each rolled-up file; NULL where no chunk was analysed, so nothing is asked."""

    def listed(name: str) -> Column:
        items = F.coalesce(F.col(name), F.expr("array()").cast("array<string>"))
        body = F.when(
            F.size(items) > 0, F.concat(F.lit("\n  - "), F.array_join(items, "\n  - "))
        ).otherwise(F.lit("None"))
        return F.concat(F.lit(f"\n{name.capitalize()}:"), body)

    opening = F.when(
        F.col("oversized_file"),
        F.lit("Summarise the beginning of the large file `"),
    ).otherwise(F.lit("Summarise the file `"))
    parts = [listed("classes")]
    if functions:
        parts.append(listed("functions"))
    if dependencies:
        parts.append(listed("dependencies"))
    prompt = F.concat(
        opening, F.col("filename"), F.lit("` from what it defines."), *parts, F.lit("\nUse plain Markdown.\n")
    )
    return files.withColumn("prompt", F.when(F.col("chunks") > 0, prompt)).withColumn(
        "prompt_hash", F.sha2("prompt", 256)
    )


def add_summaries(files: DataFrame, responses: DataFrame) -> DataFrame:
    """Attach summary replies by ``prompt_hash``: stripped text, or what went wrong, or that there was nothing."""
    joined = lookup_join(
        files, responses.select("prompt_hash", "response", F.col("error").alias("_error")), ["prompt_hash"], ["rel_path"]
    )
    summary = (
        F.when(F.col("prompt").isNull(), F.lit(config.NO_ANALYSIS))
        .when(F.col("_error").isNotNull(), F.concat(F.lit(config.SUMMARY_ERROR_PREFIX), F.col("_error")))
        .otherwise(strip(F.col("response")))
    )
    return joined.withColumn("summary", summary).drop("prompt", "prompt_hash", "response", "_error")
