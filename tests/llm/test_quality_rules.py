import re
from collections import Counter

from kgspark.llm import quality_rules
from tests.llm.conftest import prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {p for i, w in enumerate(windows) if many[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


TEXTS = [None, "", " \n\t", prose(1, 40), prose(1, 40) + "\n" + prose(1, 40), "a b c d e f g h " * 5, "The " * 60, prose(2, 9000), "ärger 漢字 " * 12 + "end.", "x y " * 25 + "done.", "one two three four five six seven eight", "w " * 9]


def test_counts_match_brute_force(docs):
    rows = {r.doc_id: r.asDict() for r in quality_rules.clean(docs(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert {k: rows[i][k] for k in want} == want, text
        assert rows[i]["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])


def test_lines(docs):
    good = prose(3, 60)
    menu = "Home | News | Sport | Contact | About"
    cases = {good: True, good + "\n" + menu: True, "\n".join([menu] * 1 + [f"{menu} {i}" for i in range(20)]): False, good.upper(): False, " ".join(w + "###" for w in good.split()): False, " ".join(w + "!!" for w in good.split()): False, good + "\nHome\nCookie policy\nClick here to subscribe now.": True, " ".join(f"{w}{i}" for i, w in enumerate(good.replace(".", "").split())): False}
    rows = {r.doc_id: r for r in quality_rules.clean(docs(list(cases))).collect()}
    for i, (text, kept) in enumerate(cases.items()):
        assert rows[i].kept == kept, text
    assert rows[1].clean_text == good and rows[6].clean_text == good


def test_passing_keeps_columns_repeated_rows_and_clean_text(docs):
    good = prose(4, 50)
    table = docs([good, good, None, "short", good + "\n" + good], [1, 1, 2, None, None])
    out = quality_rules.passing(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id or 0, r.text == good) for r in out.collect()) == [(1, True), (1, True)]  # the last repeats all its words
    assert quality_rules.clean(docs([])).count() == 0 and quality_rules.passing(docs([])).count() == 0
