import re
from collections import Counter

from corpus_cases import LONG, ODD, blank_words, documents

from cellweave.llm import quality_rules as op


def brute(text):
    t = text or ""
    w = blank_words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if blank_words(x)]
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
    return (*base, len(w) < 50 or 100 * len(repeated) > 50 * len(w))


PROSE = " ".join(f"plain{i} words{i} here{i}" for i in range(30))
CASES = [
    *ODD, (30, PROSE), (31, PROSE + "\n" + PROSE), (32, "a b c a b c a b c"), (33, "x\nx\n x\nx \n\n\n"), (34, "|*#%& <> $" * 20), (35, "a a a a a"), (36, PROSE + "\nCopyright (c) 2020 All rights reserved\nHome | About | Help | Contact"),
    (37, "Home | News | Sport | Shop\n" * 60), (38, "wow!! so!! good!! " * 30),
]


def test_counts_equal_brute_force(spark):
    docs = documents(spark, CASES, extra=("kept", "n_words", "clean_text", "x", "w", "g"))
    rows = op.quality_rules(docs).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in CASES), key=str)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert {r["x"] for r in rows} == {"x"}


def test_failing_lines_go_and_clean_text_stays(spark):
    rows = {r["doc_id"]: r for r in op.quality_rules(documents(spark, CASES)).collect()}
    assert rows[30]["kept"] and rows[30]["clean_text"] == PROSE and rows[30]["n_lines_removed"] == 0
    assert rows[36]["kept"] and rows[36]["clean_text"] == PROSE and rows[36]["n_lines_removed"] == 2
    assert not rows[37]["kept"] and rows[37]["clean_text"].strip() == ""
    assert not rows[38]["kept"]
    assert rows[6]["clean_text"] == LONG
    assert op.quality_rules(documents(spark, [])).count() == 0


def test_filter_on_the_verdict(spark):
    assert sorted(r["doc_id"] for r in op.quality_rules(documents(spark, [(30, PROSE), (37, "x")])).where("kept").collect()) == [30]


def test_line_rules_do_not_depend_on_the_length_of_a_line(spark):
    prose = PROSE + "."
    few = "buy this now " * 40
    slow = " ".join(f"w{i % 40}" for i in range(4000))  # 40 words over and over, but never close together
    cases = [(1, f"{prose}\n{few}"), (2, f"{prose}\n{few * 300}"), (3, slow), (4, f"{prose}\nHome\nAbout us\nHe left.\nOh no!\n“Yes.”\nOne two three four"), (5, prose + "\n" + " ".join(["same"] * 9))]
    rows = {r["doc_id"]: r for r in op.quality_rules(documents(spark, cases)).collect()}
    assert rows[1]["n_lines_removed"] == rows[2]["n_lines_removed"] == 1 and rows[1]["clean_text"] == rows[2]["clean_text"] == prose
    assert rows[3]["n_lines_removed"] == 0
    assert rows[4]["clean_text"] == f"{prose}\nHe left.\nOh no!\n“Yes.”\nOne two three four"
    assert rows[5]["n_lines_removed"] == 0
