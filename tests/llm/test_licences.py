"""Licence scan against plain coefficients with every template."""

import random
import re

from helixframe.llm import licences
from helixframe.llm.licence_texts import TEXTS


def plain(text, templates, threshold):
    norm = lambda s: re.sub(r"[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)).split()
    sets = {k: set(zip(norm(v), norm(v)[1:])) for k, v in templates.items()}
    groups, group = [], []
    for line in [*(text or "").split("\n"), ""]:
        w = norm(line)
        if w:
            groups.append(w)
            group.append(w)
        else:
            if len(group) > 1:
                groups.append([x for g in group for x in g])
            group = []
    out = []
    for w in groups:
        b = set(zip(w, w[1:]))
        scores = [(-2 * len(b & s) / (len(b) + len(s)), k) for k, s in sets.items() if len(b) + len(s)]
        if scores and -min(scores)[0] >= threshold:
            out.append((-min(scores)[0], min(scores)[1]))
    return sorted(out)


def test_scan(spark):
    r = random.Random(1)
    texts = [None, "", "one", "MIT", *licences.TEMPLATES.values()]
    for _ in range(150):
        lines = [" ".join(r.choice(["the", "License", "work", "é", "under", "x1"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))]
        t = r.choice(list(licences.TEMPLATES.values())).split()
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(["Foo", "licence", ""])
        cut = r.randrange(len(t))
        lines.insert(r.randint(0, len(lines)), " ".join(t[:cut]) + r.choice([" ", "\n", "\n\n", "\n  "]) + " ".join(t[cut:]))
        texts.append("\n".join(lines))
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    found = 0
    for t in texts:
        want = plain(t, licences.TEMPLATES, licences.THRESHOLD)
        assert sorted(scanner.text(t or "")) == want
        found += len(want)
    assert found > 80
    df = spark.createDataFrame([(i if i % 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_matches int")
    got = licences.scan(df).collect()
    assert len(got) == len(texts) and sum(x.n_matches for x in got) == found
    assert all((x.best_score >= 0.8) == bool(x.best_licence) == bool(x.n_matches) for x in got)
    assert licences.scan(df.limit(0)).count() == 0 and licences.scan(df, {}).where("n_matches > 0").count() == 0


def best_inside(words, template):
    """Best coefficient of all windows of a short text."""
    pairs, wanted = list(zip(words, words[1:])), licences.bigrams(licences.normalised(template).split())
    return max((2 * len(set(pairs[i:j]) & wanted) / (len(set(pairs[i:j])) + len(wanted)) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)), default=0)


def test_notices_inside_longer_passages():
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    sentence = "This project is released under the MIT License and hosted on GitHub."
    assert scanner.text(sentence) == [] and scanner.text(sentence, True) == [(1.0, "MIT")]
    header = licences.TEMPLATES["GPL-3.0-header"].split()
    wrapped = "\n".join(" ".join(header[i : i + 9]) for i in range(0, len(header), 9)) + "\n" + "\n".join(f"int v{i} of another\nreturn r{i}" for i in range(60))
    assert scanner.text(wrapped) == [] and scanner.text(wrapped, True) == [(1.0, "GPL-3.0-header")]
    for name, text in licences.TEMPLATES.items():
        assert scanner.text(text, True) == [(1.0, name)]  # a passage that has matched counts once
        assert scanner.text(f"some words before that {text} {' '.join(f'w{i}' for i in range(120))}", True) == [(1.0, name)]
    r = random.Random(2)
    for _ in range(60):
        words = licences.normalised(r.choice([t for t in licences.TEMPLATES.values() if len(t) < 100])).split()
        for _ in range(r.randint(0, 3)):
            words.insert(r.randrange(len(words)), r.choice([*words, "x"]))
        words = [f"a{i}" for i in range(30)] + words + [f"b{i}" for i in range(30)]
        want = {n: b for n, t in licences.TEMPLATES.items() if (b := best_inside(words, t)) >= 0.8}
        got = scanner.text(" ".join(words), True)
        assert bool(got) == bool(want) and all(abs(want[n] - s) < 1e-12 for s, n in got[:1])


def test_whole_licences_of_several_paragraphs(spark):
    """A licence of several paragraphs, broken into lines, with a line of copyright and a few changes, is one match of its text."""
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    r = random.Random(7)
    for name, text in TEXTS.items():
        words = text.replace(". ", ".\n\n").split(" ")
        lines = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
        for _ in range(3):
            k = r.randrange(len(lines))
            lines = lines[:k] + "x" + lines[k:]
        file = f"Some project\n\nCopyright (c) 2020 Somebody\n\n{lines}\n\n" + "\n".join(f"int v{i} = f{i}(a, b);" for i in range(40))
        got = scanner.text(file, True)
        assert name in {n for _, n in got} and max((s, n) for s, n in got if n.endswith(("text", "notice")))[1] == name, name
    df = spark.createDataFrame([(1, "word " * 300_000 + TEXTS["MIT-text"], "x")], "doc_id long, text string, licences string")
    assert licences.scan(df, inside=True).first().licences == "MIT-text"


def test_ties_go_to_the_first_name():
    scanner = licences.Scanner({"b": "some words of a licence", "a": "some words of a licence"}, 0.8)
    assert scanner.text("Some words of a licence") == [(1.0, "a")]
