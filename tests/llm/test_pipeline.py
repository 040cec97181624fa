"""The whole pipeline against a plain version of its five stages."""

import re

import numpy as np
import pytest

import corpus_pipeline
from fragmill.llm import packing, quality_rules, substring_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, sentences=8):
    rng = np.random.default_rng(seed)
    spelt = lambda: str(rng.choice(WORDS)) + "".join(rng.choice(list("abcdefgh"), 2))
    return " ".join(" ".join(spelt() for _ in range(9)).capitalize() + "." for _ in range(sentences))


def plain(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    normal = lambda x: re.sub("[0-9]", "0", " ".join(words(x)).lower())

    # quality rules
    sets = {}
    for _, text, host in rows:
        sets.setdefault(host, set()).add(frozenset(map(normal, lines(text))))
    frequent = {(h, x) for h, found in sets.items() for x in set().union(*found) if sum(x in s for s in found) > quality_rules.MAX_LINE_DOCS}
    kept = []
    for doc, text, host in rows:
        w = words(text)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 8)}
        gone = sum(len(words(x)) for x in lines(text) if (host, normal(x)) in frequent)
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and 100 * (len(w) - gone) >= quality_rules.MIN_LEFT_PERCENT * len(w):
            if any((host, normal(x)) in frequent for x in lines(text)):
                text = "\n".join(x for x in text.split("\n") if not words(x) or (host, normal(x)) not in frequent)
            kept.append((doc, text))

    # one of each component
    shingles = []
    for _, text in kept:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))
    root = list(range(len(kept)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in order:
        for b in order:
            if a != b and shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)), key=order.index)
                root[y] = x
    kept = [row for k, row in enumerate(kept) if find(k) == k]

    # repeated runs of sentences
    seen, out = {}, []
    for doc, text in sorted((r for r in kept if r[0] is not None), key=lambda r: r[0]):
        parts = substring_dedup.sentences(text)
        w = [p.lower().split() for p in parts]
        count = lambda a, b, w=w: sum(map(len, w[a : b + 1]))
        n, found = len(parts), set()
        for a in range(n):
            found |= set([(a, b) for b in range(a + 1, n) if count(a, b) >= 20][:1]) | set([(b, a) for b in range(a - 1, -1, -1) if count(b, a) >= 20][:1])
        gone = set()
        for a, b in sorted(found):
            if seen.setdefault(" ".join(" ".join(x) for x in w[a : b + 1]), (doc, a)) != (doc, a):
                gone |= set(range(a, b + 1))
        out.append((doc, "".join(p for k, p in enumerate(parts) if k not in gone)))
    out += [r for r in kept if r[0] is None]

    # secrets of fixed kinds
    secret = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""")
    return [(doc, secret.sub("[secret]", text)) for doc, text in out]


def test_pipeline(spark, tmp_path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path(corpus_pipeline.VOCABULARY))
    passage = prose(900, 4)
    rows = [(k, prose(k), "s") for k in range(8)]
    rows += [(20, prose(1), "s"), (21, prose(1).replace("alpha", "omega", 1), "t"), (22, None, "s"), (23, "too short", "s"), (24, "spam " * 60, "s"), (25, "", None)]
    rows += [(30 + k, prose(100 + k, 3) + " " + passage + " " + prose(200 + k, 3), "t") for k in range(4)]
    # a header and a footer that all pages of a host share, with a body of their own or nearly none
    rows += [(100 + k, f"{prose(500, 1)}\n{prose(300 + k, 4)}\n{prose(501, 1)}", "site") for k in range(25)]
    rows += [(200 + k, f"{prose(500, 1)}\nonly {WORDS[k]}\n{prose(501, 1)}", "site") for k in range(6)]
    rows += [(None, prose(700), "s"), (None, prose(701), "s"), (None, prose(2), "s"), (40, prose(800) + ' Password: "hunter22x" and so on.', "s"), (41, prose(801), "s"), (41, prose(802), "s")]
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(((doc, len(library.encode(text, add_special_tokens=False).ids)) for doc, text in plain(rows)), key=str)
    bins = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = sorted(((doc, n) for b in bins for doc, n in zip(b.doc_ids, b.lengths, strict=True)), key=str)
    assert got == [w for w in want if w[1]]
    assert all(sum(b.lengths) == b.used <= b.capacity in packing.CAPACITIES for b in bins) and {41} <= {d for d, _ in got} and not {20, 21, 22, 23, 24, 25, 200} & {d for d, _ in got}
