"""Whitening, spelling variants and repeated passages against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from pairgrammar.llm import recompress, spelling, whiten


def test_factor_and_turns():
    draw = np.random.default_rng(3)
    for d, rank in ((1, 1), (6, 6), (9, 4)):
        x = draw.normal(size=(60, rank)) @ draw.normal(size=(rank, d))
        scatter = x.T @ x
        factor = whiten.pivoted_cholesky(scatter)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, scatter)
        turned = whiten.jacobi(factor)
        assert np.allclose((turned**2).sum(axis=0), np.linalg.eigvalsh(scatter)[::-1][:rank])
        assert np.allclose(turned @ turned.T, scatter)
    assert whiten.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_whitening_frame(spark):
    inf, draw = float("inf"), np.random.default_rng(5)
    good = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(40, 5)))]
    good += [(7, good[3][1]), (None, good[4][1]), (50, good[5][1])]
    odd = [(60, None), (61, [1.0, None, 1.0, 1.0, 1.0]), (62, [inf, 1.0, 1.0, 1.0, 1.0]), (63, [float("nan")] * 5), (64, [1.0]), (65, [])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in good + odd], "vec_id long, embedding array<double>, x long, component long")
    got = whiten.whiten(frame, components=16).collect()
    assert len(got) == 5 * len(good) and {r.component for r in got} == {1, 2, 3, 4, 5}
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, units = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, units = values[::-1], units[:, ::-1]
    want = (x - sums / n) @ units / np.sqrt(values)
    for c in range(5):
        own = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, round(abs(r.whitened), 6)) for r in got if r.component == c + 1)
        dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
        assert own == sorted((i is None, i or 0, e, round(abs(w), 6)) for (i, _), e, w in zip(good, dev, want[:, c]))
        signs = {np.sign(r.whitened * w) for r in got if r.component == c + 1 and r.vec_id not in (None, 7) for (i, _), w in zip(good, want[:, c]) if i == r.vec_id and abs(w) > 1e-6}
        assert len(signs) == 1
    assert all(r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9 for r in got)
    assert whiten.whiten(frame.where("false")).count() == 0
    assert whiten.whiten(frame.where("vec_id = 50")).count() == 0  # all alike
    big = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten.whiten(big).collect()} == {None}


def plain_variants(rows):
    counts = {}
    for key, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "\x80" else ch
            elif run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                word = run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]
                counts[word] = counts.get(word, 0) + 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    mates = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    forms = {w: m[0] if m and words[m[0]] >= 5 * words[w] else None for w, m in mates.items()}

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, forms[w], root(w), n, len(mates[w]), words[forms[w]] if forms[w] else None) for w, n in words.items()}


def test_spelling_variants(spark):
    draw = random.Random(2)
    letters = "abÀé"
    rows = [(i, " ".join("".join(draw.choice(letters) for _ in range(draw.choice((5, 6, 6, 7)))) for _ in range(300))) for i in range(25)]
    rows += [(i, "receive " * 30 + "Recieve recieve receve " + "receivе1x") for i in range(100, 106)]
    rows += [(200, "recceive " * 160 + "reccceive " * 900), (None, None), (None, "receive"), (3, ""), (4, "x" * 5000 + " "), (4, "12 !!")]
    rows += [(300, ("ab" * 700 + " ") * 5), (300, ("ab" * 699 + "a ") * 30)]
    frame = spark.createDataFrame([(k, t, "w", 1, 2) for k, t in rows], "doc_id long, text string, word string, n long, id long")
    got = spelling.group_variants(frame.repartition(5))
    assert {tuple(r) for r in got.collect()} == plain_variants(rows)
    assert spelling.group_variants(frame.where("false")).count() == 0


def test_trie_numbers_across_ranges():
    draw = random.Random(4)
    for size in (1, 2, 3, 7, 50):
        words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 7))) for _ in range(120)})
        ranges = [words[i:i + size] for i in range(0, len(words), size)]
        bounds = [(5 * p, r[0], r[-1]) for p, r in enumerate(ranges)]
        number = {}
        for p, r in draw.sample(list(enumerate(ranges)), len(ranges)):  # in any order, in tasks that know only their ranges
            trie = spelling.TrieNumbers(bounds)
            for w in r:
                for i, node in enumerate(trie.nodes(5 * p, w)):
                    assert number.setdefault(w[:i], node) == node
        assert len(set(number.values())) == len(number)


def plain_repeats(rows):
    first = {}
    texts = [(float("inf") if k is None else k, (t or "").encode().split()) for k, t in rows]
    for k, w in texts:
        for i in range(len(w) - 12):
            first[tuple(w[i:i + 13])] = min(first.get(tuple(w[i:i + 13]), k), k)
    out = []
    for (key, _), (k, w) in zip(rows, texts):
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < k for j in range(i, i + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(("a", "b", "the", "of", *[f"w{i}" for i in range(40)]))
    passages = [[word() for _ in range(draw.randint(12, 60))] for _ in range(12)]
    passages += [["a"] * 30, ["a"] * 6 + ["b"] * 7, ["a", "b"] * 15, ["la", "la", "lo"] * 9, ["a"] * 5000]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += [word() for _ in range(draw.randint(0, 20))]
            p = draw.choice(passages)
            cut = draw.randint(0, 3)
            words += p[cut:len(p) - draw.randint(0, 3)]
        rows.append((draw.choice((i, i, i, 5, None)), draw.choice((" ", "\n ", "\t")).join(words)))
    return rows + [(900, None), (901, ""), (902, " \n "), (5, rows[7][1]), (5, rows[7][1]), (903, rows[7][1]), (904, "x y " * 40), (905, "x y " * 14)]


def test_repeated_passages(spark):
    for seed in (1, 2):
        rows = repeat_rows(seed)
        frame = spark.createDataFrame([(k, t, 1, "r", 2) for k, t in rows], "doc_id long, text string, rank long, ident string, n_words long")
        got = recompress.remove_repeats(frame.repartition(4))
        assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == plain_repeats(rows)
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())
    assert recompress.remove_repeats(frame.where("false")).count() == 0


def test_chunks_and_slices_decide_alike():
    """Texts cut into overlapping chunks, in slices, over parts: the same taken words as one slice of whole texts."""
    rows = [(k, i, (t or "").encode().split()) for i, (k, t) in enumerate(repeat_rows(3)) if k is not None]
    hashes = recompress._Hashes()

    def taken(chunk, per_slice, parts):
        held, found = [], {}
        for rank, ident, words in rows:
            h = np.array([hashes[w] for w in words], np.uint64)
            held += [(h[b:b + chunk + 12], rank, ident, b) for b in range(0, max(0, len(h) - 12), chunk)]
        batches = []
        for s in range(0, len(held), per_slice):
            words, *rest = zip(*held[s:s + per_slice])
            batches += recompress.summarise(list(words), *[np.array(x, np.int64) for x in rest], parts)
        flat = lambda bs, c: np.concatenate([b.column(c).flatten().to_numpy() for b in bs]) if bs else np.zeros(0, np.int64)
        done = [b for b in batches if b.column("done")[0].as_py()]
        open_ = [b for b in batches if not b.column("done")[0].as_py()]
        ranges = [tuple(flat(done, c) for c in ("rank", "ident", "at", "shape"))]
        for p in range(parts):
            own = [b.filter(pa.array([x == p for x in b.column("part").to_pylist()])) for b in open_]
            ranges.append(recompress.judge(*[flat(own, c) for c in ("rank", "ident", "at")], flat(own, "shape").astype(np.int64), flat(own, "key").astype(np.int64), flat(own, "rest").astype(np.int16)))
        for rank, ident, at, size in ranges:
            for i, a, n in zip(ident.tolist(), at.tolist(), size.tolist()):
                found.setdefault(i, set()).update(range(a, a + n))
        return found

    whole = taken(1 << 20, 1 << 20, 1)
    assert whole and whole == taken(17, 5, 3) == taken(64, 1000, 7)
