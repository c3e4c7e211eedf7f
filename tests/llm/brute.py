"""Plain Python counterparts of the operators, over lists of (doc_id, text, lang, source)."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tests.llm.common import words
from twinspan.llm import anchors, minhash_dedup, quality_rules
from twinspan.llm.symbols import text_buffers

def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()

def passages(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    order = lambda i: anchors.NO_ID if i is None else i
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            t = tuple(w[k:k + window])
            first[t] = min(first.get(t, order(i)), order(i))
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < order(i) for j in range(k, k + window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out

def strings(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out

def near_classes(rows):
    """class_id of each row, from the weighted similarity of all pairs with five-word shingles."""
    data, offsets = text_buffers(pa.array([t for _, t, *_ in rows], pa.string()))
    s = minhash_dedup.shingles(data, offsets)
    n = len(rows)
    cells = [set((s.hashes[a:b] % minhash_dedup.CELLS).tolist()) for a, b in zip(s.offsets[:-1], s.offsets[1:])]
    df = Counter(c for cs in cells for c in cs)
    sets = []
    for a, b in zip(s.offsets[:-1], s.offsets[1:]):
        rarity = lambda h: 1 - 0.1 * max(0.0, math.log(64 * df[int(h) % minhash_dedup.CELLS] / n)) / math.log(64)
        sets.append({int(h): (1 + math.log(c)) * rarity(h) for h, c in zip(s.hashes[a:b], s.counts[a:b])})
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    margin = 1.0
    for i in range(n):
        for j in range(i):
            if not sets[i] or not sets[j]:
                continue
            both = sum(min(w, sets[j][h]) for h, w in sets[i].items() if h in sets[j])
            similarity = both / (sum(sets[i].values()) + sum(sets[j].values()) - both)
            margin = min(margin, abs(similarity - minhash_dedup.SIMILARITY))
            if similarity >= minhash_dedup.SIMILARITY or words(rows[i][1]) == words(rows[j][1]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    order = lambda i: anchors.NO_ID if i is None else i
    for i in range(n):
        ids[find(i)].append(rows[i][0])
    return [(rows[i][0], min(ids[find(i)], key=order)) for i in range(n)], margin

def base_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, number of lines with a word."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    triples = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    repeated = {j for i, t in enumerate(triples) if seen[t] > 1 for j in range(i, i + 3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n, len(lines))

def quality(rows):
    """(doc_id, six statistics, kept) of each row, the estimates with numpy's linear algebra."""
    q = quality_rules
    stats = [base_statistics(t) for _, t, *_ in rows]
    x = np.array([[math.log(max(n, 1)), c / max(n, 1), math.log1p(100 * s / max(c, 1)), math.log1p(10 * d / max(lines, 1)), math.sqrt(r / max(n, 1))]
                  for n, c, s, d, r, _, lines in stats]).reshape(-1, q.D)
    good = np.array([not s[5] for s in stats], bool)
    floors = np.array(q.FLOORS)
    groups = [(lang, source) for _, _, lang, source in rows]

    def lower(values, share):
        """The least value that at least this share of the values doesn't exceed."""
        return np.sort(values)[max(0, math.ceil(share * len(values)) - 1)]

    members = defaultdict(list)
    for i, g in enumerate(groups):
        if good[i]:
            members[g].append(i)
    estimate = {}
    for g in members:
        same = x[[i for i in range(len(rows)) if good[i] and groups[i][0] == g[0]]]
        spread = [max((lower(c, .75) - lower(c, .25)) / 1.349, f) for c, f in zip(same.T, floors)]
        estimate[g] = (np.array([lower(c, .5) for c in same.T]), np.diag(1 / np.square(spread)))
    distance = lambda v, e: (v - e[0]) @ e[1] @ (v - e[0])
    for _ in range(q.C_STEPS):
        core = {}
        for g, own in members.items():
            d = np.array([distance(x[i], estimate[g]) for i in own])
            core[g] = x[[i for i, k in zip(own, d) if k <= lower(d, q.CORE)]]
        estimate = {}
        for g, v in core.items():
            of_language = np.concatenate([u for h, u in core.items() if h[0] == g[0]])
            pm, pc = of_language.mean(axis=0), q.CONSISTENCY * np.cov(of_language.T, bias=True)
            total = len(v) + q.PRIOR
            mean = (v.sum(axis=0) + q.PRIOR * pm) / total
            second = v.T @ v + q.PRIOR * np.outer(pm, pm) - total * np.outer(mean, mean)
            cov = (q.CONSISTENCY * second + q.PRIOR * pc) / total
            estimate[g] = (mean, np.linalg.inv(cov + np.diag(floors**2)))
    out = []
    for i, (row, s) in enumerate(zip(rows, stats, strict=True)):
        far = groups[i] in estimate and distance(x[i], estimate[groups[i]]) > q.CUTOFF
        out.append((row[0], *s[:6], not s[5] and not far))
    return out

def chat_digests(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return out

def top_k(rows, k=5):
    """(query_id, rank, vec_id, score) from (vec_id, embedding)."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(whole):
        if q % 50:
            continue
        found = sorted((-sum(x * y for x, y in zip(v, u)), c) for b, (c, u) in enumerate(whole) if b != a and len(u) == len(v))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return out
