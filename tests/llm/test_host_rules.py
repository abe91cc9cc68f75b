import re
from collections import Counter

from dripline.llm.host_rules import host_verdicts, measured, quality_verdicts


def brute(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(own, own[1:], own[2:], strict=False))
    covered = set()
    for i in range(len(own) - 2):
        if seen[tuple(own[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(x in "#*$%&|<>" for x in text or "")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_against_brute_force(spark):
    texts = [
        None, "", " \n\t\n ", "a", "a b c", "a b c a b c", "a a a a a", "x y z q x y z y z q x",
        "line\nline\n \nline\nother", "#*$%&|<> é😀 ##", "\x0ba\x1cb\x0cc", "a b c d " * 30,
        "one two three four one two three five two three four",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = frame.selectExpr("*", "'h' AS source")
    for row in measured(frame, "doc_id", "text", "source").collect():
        assert tuple(row[x] for x in NAMES) == brute(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_hosts_are_shrunk_towards_the_common_rate(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [("big", good)] * 40 + [("big", bad)] * 2 + [("junk", bad)] * 40 + [("new", bad)]
    rows += [("fair", good)] * 30 + [(None, bad), (None, good)]
    frame = spark.createDataFrame(
        [(i, text, host) for i, (host, text) in enumerate(rows)],
        "doc_id long, text string, source string",
    )
    verdicts = quality_verdicts(frame).collect()
    kept = Counter((row["host"], row["base_failed"], row["kept"]) for row in verdicts)
    assert kept["big", False, True] == 40 and kept["junk", True, False] == 40
    assert kept[None, False, True] == 1
    rates = {row["host"]: row["host_rate"] for row in verdicts}
    mean = (2 / 42 + 1 + 1 + 0) / 4
    assert 2 / 42 < rates["big"] < mean and mean < rates["new"] < rates["junk"] < 1
    assert rates[None] is None


def test_equal_hosts_have_the_common_rate(spark):
    rows = [(i, "short", "ab"[i % 2]) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hosts = host_verdicts(measured(frame, "doc_id", "text", "source")).collect()
    assert [(row["shrunk_rate"], row["host_kept"]) for row in hosts] == [(1.0, False)] * 2


def test_odd_rows(odd_documents, no_documents):
    rows = quality_verdicts(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    texts = {}
    for row in odd_documents.collect():
        texts.setdefault(row["doc_id"], []).append(brute(row["text"]))
    assert all(tuple(row[x] for x in NAMES) in texts[row["doc_id"]] for row in rows)
    assert quality_verdicts(no_documents).collect() == []


def test_no_python_runs(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = measured(frame, "doc_id", "text", "source")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
