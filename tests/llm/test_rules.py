"""Line rules against a plain version, word by word."""

import random
import re

import pyarrow.dataset as ds
import pytest

from fotolith.llm import rules

P, N, B = rules.PUNCTUATION, rules.NAVIGATION, rules.BOILERPLATE


def plain_fault(line):
    """The rules as the module states them, in their order."""
    words = re.findall(r"\S+", line)
    n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
    share = lambda test: sum(1 for w in words if test(w)) / len(words)
    bars = len(re.findall("[|›»·•]", line))
    end = re.search("[.!?\"'”’»:;)\\]…。！？][\x20\x09-\x0D]*$", line)
    if bars >= 3 and 4 * bars >= n:
        return N
    if len(re.findall(r"[#*$%&|<>]", line)) > 0.3 * n + 2 or 2 * len(re.findall("!!", line)) > n:
        return P
    if n < 3 and not end or n >= 30 and not re.search("[.!?…。！？]", line):
        return P
    if n >= 4 and line.upper() == line and line.lower() != line and not any(c.istitle() and not c.isupper() for c in line):
        return P
    if n < 40 and re.search("[©®™]", line):
        return B
    if n >= 4 and not end and share(lambda w: w[0].isupper()) >= 0.8:
        return N
    if share(lambda w: "://" in w or "www." in w or "@" in w) > 0.5:
        return B
    if n >= 8 and any(share(lambda w, x=x: w == x) > 0.5 for x in set(words)):
        return B
    return 0


def plain_verdict(text):
    """Kept, the cleaned text and the faults of a whole text."""
    faults, stay, lost, seen = [0] * 4, [], 0, set()
    lines = text.split("\n")
    for line in lines:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        fault = n and (B if line in seen else plain_fault(line))
        if n:
            seen.add(line)
        if fault:
            faults[fault] += 1
            lost += n
        else:
            stay.append(line)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else None
    if count is None:
        return None
    hit = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return not failed and 2 * (len(words) - lost) >= len(words), "\n".join(stay), faults[1:]


@pytest.mark.parametrize(
    "line, fault",
    [
        ("Home | News | Sport | Contact", N), ("Inicio › Noticias › Deportes › Madrid", N), ("Startseite Angebote Kontakt Impressum", N), ("Accueil Boutique Panier Compte", N),
        ("BUY NOW AND SAVE MONEY", P), ("yes!! no!! more!!", P), ("menu", P), ("a ### b *** c $$$", P), (" ".join(f"w{i}" for i in range(30)), P),
        ("© 2024 Beispiel GmbH, alle Rechte vorbehalten.", B), ("mail me@example.org www.example.org", B), ("de de de de de de de de de", B),
        ("This is a sentence of a text.", 0), ("Das ist ein Satz.", 0), ("Une phrase.", 0), ("no end but lower case words", 0), ("The GDP of China | a table", 0), ("", None),
    ],
)
def test_line_rules_by_example(line, fault):
    if fault is not None:
        assert rules.line_fault(line, len(line.split())) == fault == plain_fault(line)


def test_line_rules_by_the_plain_version():
    rng = random.Random(2)
    parts = ["word", "Word", "WORD", "ÉTÉ", "été.", "|", "›", "!!", "no!!", "***", "©", "a@b.c", "www.x.y", "12", "end.", "e", "中文。", "ß", "x"]
    for _ in range(6000):
        some = rng.sample(parts, rng.randint(1, 5))
        line = " ".join(rng.choice(some) for _ in range(rng.choice([1, 2, 3, 4, 8, 12, 29, 30, 40, 45])))
        assert rules.line_fault(line, len(line.split())) == plain_fault(line), line


def test_verdicts_by_the_plain_version(sf):
    texts = [t or "" for t in ds.dataset(f"{sf}/documents.parquet").to_table()["text"].to_pylist()] + ["", "\n\n", " \x85 \u3000", "a\n" * 30]
    judged = rules.judge(texts)
    checked = 0
    for text, row in zip(texts, judged):
        if (want := plain_verdict(text)) is None:
            continue
        kept, clean, faults = want
        assert (row[6], row[10], list(row[11:])) == (kept, clean if any(faults) else text, faults)
        checked += 1
    assert checked > 150 and 0 < sum(r[6] for r in judged) < len(texts)
