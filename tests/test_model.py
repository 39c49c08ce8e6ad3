import time

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import replies
from corpuslens.operators import model, rollup
from corpuslens.plans import analyze

GOOD = '{"description": "d", "classes": ["A"]}'


def normalised(spark, reply, error=None, **options):
    df = spark.createDataFrame([(reply, error)], "response string, error string")
    row = model.normalise_replies(df, **options).first()
    return row["parse_route"], row["description"], row["classes"], row["functions"], row["dependencies"]


CASES = [
    (GOOD, ("direct", "d", ["A"], None, None)),
    (f"Sure!\n{GOOD}\nBye", ("direct", "d", ["A"], None, None)),
    (f"{{}} then {GOOD}", ("repaired", None, None, None, None)),
    ('{"description": "a: b", "classes": ["**A**"], "functions": ["f()": "does"]}',
     ("repaired", "a b", ["A"], ["f(): does"], None)),
    ('{"classes": ["A"], "description": "d"}', ("repaired", "d", ["A"], None, None)),
    ("This is not a JSON response", ("fallback", "Could not analyze chunk", [], [], [])),
    ('{"description": "d", "classes": [}', ("fallback", "Could not analyze chunk", [], [], [])),
    ('{"description": "d", "classes": ["A",]}', ("fallback", "Could not analyze chunk", [], [], [])),
    ('```json\n{"classes": ["A"], "description": "d"}\n```', ("repaired", "d", ["A"], None, None)),
    ('```\n{"a": 1}\n```\n```json\n{"classes": ["B"], "description": "second"}\n```',
     ("repaired", "second", ["B"], None, None)),
    ('{"classes": [], "description": "d", "functions": ["f() -> int": "gives", "x = 1": "sets x"]}',
     ("repaired", "d", [], ["f(): gives", "x = 1: sets x"], None)),
    ('{"classes": [], "description": "d", "dependencies": ["os": "paths", "sys"]}',
     ("repaired", "d", [], None, ["os: paths", "sys"])),
    ('{"description": "d", "functions": ["a", "b", "dependencies": "x", "classes": 1}',
     ("repaired", "d", None, ["a", "b"], None)),
    ('{"classes": ["A"], "functions": [1, {"a": 2}]}', ("repaired", "No description available", ["A"], ["1", '{"a":2}'], None)),
    ('{"description": "d", "classes": ["A"], "classes": ["B"]}', ("direct", "d", ["B"], None, None)),
    ('{"classes": ["A"], "description":' + " " * 70 + '"a: b"}', ("repaired", "a b", ["A"], None, None)),
    ('{"classes": ["A"], "description": "x\\n: y"}', ("repaired", "x\n y", ["A"], None, None)),
]


@pytest.mark.parametrize("reply,want", CASES)
def test_normalise(spark, reply, want):
    got = normalised(spark, reply)
    if want[0] == "repaired" and want[1] is None:
        assert got[0] == "fallback"  # braces around both objects parse as neither
    else:
        assert got == want


def test_errors_and_switched_off_sections(spark):
    assert normalised(spark, None, "Test error") == ("error", "Error during analysis: Test error", [], [], [])
    assert normalised(spark, "none", functions=False, dependencies=False)[3:] == (None, None)


@pytest.mark.parametrize("text,want", [
    ("<think>a</think># T:", "## T"), ("# A\nx\n# A\n## A", "## A\nx"), ("```md\n# A\n```\nrest", "## A\n\nrest"),
    ("```\nx\ny", "x\ny"), ("```x", "x"), ("plain", "plain"), ("### [a](b):", "### [a](b):"), ("  # in: ", "  # in: "),
    ("#a\n#a", "##a"), ("<think>a\nb</think>\nx", "\nx"),
])
def test_clean_summary(spark, text, want):
    assert spark.range(1).select(replies.clean_summary(F.lit(text))).first()[0] == want


def test_reply_text(spark):
    df = spark.createDataFrame([(("c", "p"),), ((None, "p"),)], "r struct<content:string,prediction:string>")
    assert [r[0] for r in df.select(replies.reply_text(F.col("r"), "content", "prediction")).collect()] == ["c", "p"]


def prompts(spark, texts):
    return spark.createDataFrame([(t, t) for t in texts], "prompt_hash string, prompt string")


def answers(df):
    return {r["prompt_hash"]: (r["response"], r["error"], r["attempts"]) for r in df.collect()}


def test_infer_retries_only_timeouts(spark):
    def provider():
        calls = {}

        def client(texts, timeout):
            out = []
            for t in texts:
                calls[t] = calls.get(t, 0) + 1
                if t == "late" or (t == "slow" and calls[t] < 2):
                    out.append(TimeoutError("late"))
                elif t == "bad":
                    out.append(ValueError("bad"))
                else:
                    out.append(t.upper())
            return out

        return client

    got = answers(model.infer(prompts(spark, ["a", "late", "slow", "bad"]), provider, tasks=1, pause=0.0))
    assert got == {
        "a": ("A", None, 1), "slow": ("SLOW", None, 2), "bad": (None, "bad", 1), "late": (None, "late (3 attempts)", 3),
    }


def test_a_failing_call_does_not_fail_its_neighbours(spark):
    def provider():
        def client(texts, timeout):
            if "bad" in texts:
                raise RuntimeError("broken")
            return [t.upper() for t in texts]

        return client

    got = answers(model.infer(prompts(spark, ["a", "bad", "b"]), provider, tasks=1))
    assert got == {"a": ("A", None, 1), "b": ("B", None, 1), "bad": (None, "broken", 1)}


def test_a_failing_call_is_halved(spark):
    def provider():
        made = []

        def client(texts, timeout):
            made.append(len(texts))
            if "bad" in texts:
                raise RuntimeError("broken")
            return [f"{len(made)} {made[-1]}"] * len(texts)

        return client

    got = answers(model.infer(prompts(spark, ["bad", *map(str, range(15))]), provider, tasks=1))
    assert got["bad"][:2] == (None, "broken") and sum(error is None for _, error, _ in got.values()) == 15
    # 16 prompts with one bad: at most two calls a halving, not 17
    assert max(int(reply.split()[0]) for reply, error, _ in got.values() if error is None) <= 9


def test_batches_keep_their_budget():
    rows = [(str(i), "x" * (4 * n)) for i, n in enumerate([3, 3, 3, 20, 0, 5, 5, 1, 1, 1, 1, 1, 1])] + [("n", None)]
    parts = list(model.pack(iter(rows), 4, 10))
    assert [row for part in parts for row in part] == rows
    tokens = [[len(text or "") // 4 for _, text in part] for part in parts]
    assert all(len(part) == 1 or (len(part) <= 4 and sum(part) <= 10) for part in tokens)
    assert tokens == [[3, 3, 3], [20], [0, 5, 5], [1, 1, 1, 1], [1, 1, 0]]
    assert list(model.pack(iter([]), 4, 10)) == []
    # the estimate counts bytes, as that of files does
    assert len(list(model.pack(iter([("a", "\u00e9" * 20), ("b", "x")]), 4, 9))) == 2


def timed():
    """Says when each call began and ended, and refuses two calls at once by one client."""
    busy = []

    def client(texts, timeout):
        if busy:
            raise RuntimeError("a client at work was called")
        busy.append(1)
        start = time.time()
        time.sleep(0.5)
        busy.pop()
        return [f"{start} {time.time()}"] * len(texts)

    return client


def test_calls_overlap_within_a_task(spark):
    got = answers(model.infer(prompts(spark, list("abcdefgh")), timed, tasks=1, batch=1, in_flight=4))
    assert len(got) == 8 and all(error is None for _, error, _ in got.values())
    spans = [tuple(map(float, reply.split())) for reply, _, _ in got.values()]
    at_once = [sum(a <= start < b for a, b in spans) for start, _ in spans]
    assert 2 <= max(at_once) <= 4
    assert max(b for _, b in spans) - min(a for a, _ in spans) < 8 * 0.5


def test_calls_keep_the_rate(spark):
    asked = prompts(spark, list("abcdef"))
    got = answers(model.infer(asked, timed, tasks=1, batch=1, in_flight=6, calls_per_second=5))
    starts = sorted(float(reply.split()[0]) for reply, _, _ in got.values())
    assert starts[-1] - starts[0] >= 5 * 0.2 - 0.1
    with pytest.raises(ValueError):
        model.infer(asked, timed, calls_per_second=0)


def test_a_hanging_call_is_given_up(spark):
    def provider():
        def client(texts, timeout):
            time.sleep(3 if texts[0] == "hang" else 0)
            return list(texts)

        return client

    got = answers(model.infer(prompts(spark, ["hang"]), provider, tasks=1, tries=2, pause=0.0, timeout=0.3))
    assert got["hang"][1] == "no reply within 0.3 seconds (2 attempts)" and got["hang"][2] == 2


def test_calls_of_a_client_share_a_thread_and_their_replies_a_frame(spark):
    import threading

    def provider():
        return lambda texts, timeout: [str(threading.get_ident())] * len(texts)

    frames = []

    class Taken:  # what ``infer`` gives Spark, taken and called here
        sparkSession = spark
        select = repartition = lambda self, *a: self

        def mapInPandas(self, call, schema):
            import pandas as pd

            frames.extend(call(iter([pd.DataFrame({"prompt_hash": list("abcdef"), "prompt": list("abcdef")})])))

    model.infer(Taken(), provider, tasks=1, batch=1)
    assert [list(f["prompt_hash"]) for f in frames] == [list("abcdef")]
    assert frames[0]["response"].nunique() == 1 and frames[0]["error"].isna().all()


def test_a_call_behind_a_hanging_one_has_a_thread_of_its_own(spark):
    def provider():
        def client(texts, timeout):
            time.sleep(3 if texts[0] == "hang" else 0)
            return list(texts)

        return client

    got = answers(model.infer(prompts(spark, ["hang", *"abc"]), provider, tasks=1, batch=1, tries=1, pause=0.0, timeout=0.5))
    assert got.pop("hang")[1] == "no reply within 0.5 seconds (1 attempts)"
    assert got == {name: (name, None, 1) for name in "abc"}


def canned():
    def client(texts, timeout):
        return [
            '{"description": "d", "classes": ["C"], "functions": ["f(): x"], "dependencies": ["os", "sys"]}'
            if "source file" in t else "  summary  "
            for t in texts
        ]

    return client


def test_whole_run_asks_each_prompt_once(spark, files, tmp_path):
    df = files([("a.py", "x\ny\n"), ("b.py", ""), ("d/a.py", "x\ny\n")])
    store = str(tmp_path / "store")
    got = {r["rel_path"]: r for r in analyze.analyze_files(df, canned, store).collect()}
    assert got["a.py"]["classes"] == ["C"] and got["a.py"]["dependencies"] == ["os", "sys"]
    assert got["a.py"]["summary"] == "summary" and got["b.py"]["summary"] == "No analysis available for this file."
    assert (got["b.py"]["total_lines"], got["a.py"]["chunks_analyzed"]) == (0, 1)
    # a.py and d/a.py share name, span and text: one prompt, one reply.
    from corpuslens.sources import store as stores

    assert stores.read_responses(spark, store).count() == 2

    def never():
        def client(texts, timeout):
            raise AssertionError("asked again")

        return client

    again = {r["rel_path"]: r["summary"] for r in analyze.analyze_files(df, never, store).collect()}
    assert again == {r: got[r]["summary"] for r in got}


def test_unreadable_file_becomes_an_error_row(spark, files):
    df = files([("a.py", "class A\n"), ("b.py", None)])
    got = {r["rel_path"]: r for r in analyze.analyze_files(df).collect()}
    assert got["b.py"]["error"] == "content could not be read" and got["b.py"]["has_errors"]
    assert got["a.py"]["classes"] == ["A"] and got["a.py"]["error"] is None
    records = rollup.to_records(analyze.analyze_files(df)).collect()
    failed = [r for r in records if r["rel_path"] == "b.py"]
    assert [(r["document"], r["has_error"], r["filename"]) for r in failed] == [
        ("Error analyzing file: content could not be read", True, "b.py")
    ]


def test_failed_chunk_keeps_the_good_ones(spark, files, tmp_path):
    def provider():
        def client(texts, timeout):
            return [
                ValueError("no") if "lines 1-" in t and "source file" in t
                else '{"description": "d", "classes": ["Late"], "functions": []}' if "source file" in t else "s"
                for t in texts
            ]

        return client

    row = analyze.analyze_files(files([("a.py", "x\n" * 6)]), provider, str(tmp_path / "s"), size=4).first()
    assert (row["chunks"], row["chunks_analyzed"], row["has_errors"], row["classes"]) == (2, 1, True, ["Late"])


def test_blank_paths_are_rejected(spark, files):
    df = analyze.analyze_files(files([("a.py", "x")])).withColumn("file_path", F.lit(""))
    assert rollup.valid_files(df).count() == 0 and rollup.rejected_files(df).count() == 1


def test_brackets_within_strings_of_a_section(spark):
    from corpuslens.functions import replies

    cases = [
        ('"functions": ["f(x: List[int])": "does", "g(y)": "more"]', '"functions": ["f(x: List[int]): does", "g(y): more"]'),
        ('"functions": ["f(x)": "does"], "dependencies": ["a[0]"]', '"functions": ["f(x): does"], "dependencies": ["a[0]"]'),
        ('"functions": ["a\\"[b]": "c"]', '"functions": ["a\\"[b]": "c"]'),  # an escaped quote ends no pair
        ('"functions": ["f": "open', '"functions": ["f": "open'),
        ('"functions": []', '"functions": []'),
    ]
    table = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, text string")
    from pyspark.sql import functions as F

    got = {r["i"]: r["t"] for r in table.select("i", replies.join_pairs(F.col("text"), "functions").alias("t")).collect()}
    assert {i: got[i] for i in (0, 1, 3, 4)} == {i: cases[i][1] for i in (0, 1, 3, 4)}
    assert got[2].startswith('"functions": [')


def test_stored_responses_are_folded_and_only_asked_ones_are_shuffled(spark, tmp_path):
    from corpuslens.sources import store as stores

    store = str(tmp_path / "s")
    assert stores.read_responses(spark, store) is None
    rows = lambda *r: spark.createDataFrame(list(r), "prompt_hash string, response string, error string, attempts int")
    for k in range(10):  # prompt x fails twice, is answered, and fails again; y never has an answer
        failed = k != 2
        x = ("x", None if failed else "good", f"bad {k}" if failed else None, 1)
        stores.write_responses(rows(x, (f"p{k}", f"r{k}", None, 1), ("y", None, f"no {k}", k)), store, fold_after=3)
    live = stores._generations(spark, store, stores.RESPONSES, stores.RESPONSES_FOLDED)
    assert len(live) <= 6 and any("@base" in n for n in live)
    held = {r["prompt_hash"]: (r["response"], r["error"], r["attempts"]) for r in stores.read_responses(spark, store).collect()}
    assert held == {"x": ("good", None, 1), "y": (None, "no 9", 9)} | {f"p{k}": (f"r{k}", None, 1) for k in range(10)}
    asked = spark.createDataFrame([("p3",), ("y",), ("unknown",)], "prompt_hash string")
    some = stores.read_responses(spark, store, asked)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    # what the join leaves is below the only shuffle
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")
    assert sorted(r["prompt_hash"] for r in some.collect()) == ["p3", "y"]
    assert stores.read_responses(spark, store, asked.limit(0)).count() == 0


def test_declarations_are_sought_by_their_first_letter(spark):
    from pyspark.sql import functions as F

    from corpuslens.functions.text import WORD
    from corpuslens.operators.model import CLASS, FUNCTION

    texts = ["subclass A class  B_é classclass C éclass D", "function f func g functionfunc h func\tx def  def def y xdef z 1func q",
             "class", "enum X\ninterface Y structstruct S _struct T", "functional f func  é9 fundef a", "interfaceclass Z interface  class W"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(1))
    for pattern, words, letters in ((CLASS, "class|interface|struct|enum", "[ceis]"), (FUNCTION, "def|function|func", "[df]")):
        plain = rf"(?:{words})(?<!{WORD}(?:{words})) +({WORD}+)"
        assert pattern.startswith(letters)  # not the words themselves, at every place
        assert table.filter(found(pattern) != found(plain)).count() == 0
