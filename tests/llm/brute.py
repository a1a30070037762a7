"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, values, bits=4):
    """{id: smallest id of its group}: all pairs within ``bits`` are linked."""
    values = np.array(values, np.uint64)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, d in enumerate(ids)}


def repeats(words, size=8):
    seen = {}
    for i in range(len(words) - size + 1):
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + size)})


def base_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats(words)


def ids_crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def hashed(words, dims):
    """Square roots of hashed word counts, of length 1."""
    x = np.zeros(dims)
    for w in words:
        x[zlib.crc32(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode()) % dims] += 1
    x = np.sqrt(x)
    return x / max(np.linalg.norm(x), 1e-12)


def raked(rows, targets, limits=(), rounds=400):
    """{id: probability}: weights of rows (cell, tokens) scaled in turn to the targets of every dimension; the largest is 1."""
    total = sum(t for _, t in rows.values())
    wanted = []
    for k, target in enumerate(targets):
        own = {}
        for cell, t in rows.values():
            own[cell[k]] = own.get(cell[k], 0) + t / total
        want = {v: min(s, own.get(v, 0)) if k in limits else s for v, s in target.items()}
        left = 1 - sum(want.values())
        rest = own.get(None, 0)
        want = {**want, None: left} if left > 1e-9 else {**{v: s / sum(want.values()) * (1 - rest) for v, s in want.items()}, None: rest}
        there = {v: s for v, s in want.items() if own.get(v, 0) > 0}
        wanted.append({v: s / sum(there.values()) for v, s in there.items()})
    cells = {}
    for cell, t in rows.values():
        cells[cell] = cells.get(cell, 0) + t
    weight = dict.fromkeys(cells, 1.0)
    for _ in range(rounds):
        for k, want in enumerate(wanted):
            now = {}
            for c, t in cells.items():
                now[c[k]] = now.get(c[k], 0) + t * weight[c]
            whole = sum(now.values())
            weight = {c: w * want[c[k]] * whole / now[c[k]] if now[c[k]] > 0 else w for c, w in weight.items()}
    top = max(w for c, w in weight.items() if cells[c] > 0)
    return {d: min(1.0, weight[c] / top) for d, (c, _) in rows.items()}


def peaks(samples, size=256, hop=128, bands=(1, 9, 17, 33, 65, 129), standout=4.0):
    """(frame, bin) of the peaks of a sound by one transform at a time: the strongest bin of each band, where it stands out in its band and in time."""
    x = np.concatenate([np.zeros(hop, np.float32), (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128])
    frames = []
    at = 0
    while at + size <= len(x):
        frames.append(x[at : at + size])
        at += hop
    frames.append(np.pad(x[at:], (0, size - len(x[at:]))))
    window = np.hanning(size).astype(np.float32)
    value, bins = [], []
    for f in frames:
        z = np.fft.rfft(f * window)
        e = z.real**2 + z.imag**2
        value.append([e[a:b].max() if e[a:b].max() > standout * e[a:b].mean() else 0 for a, b in zip(bands, bands[1:])])
        bins.append([a + int(e[a:b].argmax()) for a, b in zip(bands, bands[1:])])
    value = np.array(value)
    before, after = np.vstack([np.zeros(5), value[:-1]]), np.vstack([value[1:], np.zeros(5)])
    return [(int(t), bins[t][k]) for t, k in np.argwhere((value > 1e-6) & (value > before) & (value >= after))]


def n_peaks(samples):
    return len(peaks(samples))


def peak_pairs(samples, fan=3, reach=32):
    """Sorted (frame, hash) of each peak with the next ones that are near."""
    p = peaks(samples)
    return sorted((t, b << 16 | c << 8 | u - t) for i, (t, b) in enumerate(p) for u, c in p[i + 1 : i + 1 + fan] if u - t <= reach)


def url_tree(rows, many=20, least=5, width=1.0, grid=200, prior=6.0, floor=0.7):
    """{(host, segments): (template, purity, verdict)} for rows (host, segments, label or None): the tree built node by node."""
    marked = [x for *_, x in rows if x is not None]
    share = sum(marked) / len(marked) if marked else 1.0
    at = {(h, s): list(s) for h, s, _ in rows}
    counts = {}
    for h, s, x in rows:
        c = counts.setdefault((h, s), [0, 0, 0.0])
        c[0] += 1
        c[1] += x is not None
        c[2] += x or 0.0
    depth = max((len(s) for _, s in at), default=0)

    def nodes(level):
        out = {}
        for key, t in at.items():
            if len(t) > level:
                out.setdefault((key[0], tuple(t[:level])), {}).setdefault(t[level], []).append(key)
        return out

    for level in range(depth):
        for children in nodes(level).values():
            n = sorted((sum(counts[k][0] for k in keys) for keys in children.values()), reverse=True)[1:]
            if n and math.exp(-sum(x / sum(n) * math.log(x / sum(n)) for x in n)) >= many - 1e-6:
                for keys in children.values():
                    for k in keys:
                        at[k][level] = "*"
    purity = lambda n, g: (g + prior * share) / (n + prior)
    for level in reversed(range(depth)):
        for children in nodes(level).values():
            cells, few = {}, []
            for keys in children.values():
                n, g = sum(counts[k][1] for k in keys), sum(counts[k][2] for k in keys)
                if n < least:
                    few.append(keys)
                else:
                    c = cells.setdefault(math.floor(purity(n, g) * grid), [0, 0.0, []])
                    c[0], c[1] = c[0] + n, c[1] + g
                    c[2].append(keys)
            groups = [cells[c] for c in sorted(cells)]
            while len(groups) > 1:
                gaps = []
                for (n, g, _), (m, f, _) in zip(groups, groups[1:]):
                    p, q = purity(n, g), purity(m, f)
                    gaps.append(0 if p == q else abs(p - q) / math.sqrt(p * (1 - p) / (n + prior) + q * (1 - q) / (m + prior)))
                k = gaps.index(min(gaps))
                if gaps[k] > width:
                    break
                groups[k : k + 2] = [[a + b for a, b in zip(groups[k], groups[k + 1])]]
            for name, own in [("+", few), *((f"+{i + 1}", g[2]) for i, g in enumerate(groups))]:
                for keys in own if len(own) > 1 else ():
                    for k in keys:
                        at[k][level] = name
    sums = {}
    for key, t in at.items():
        s = sums.setdefault((key[0], tuple(t)), [0, 0.0])
        s[0], s[1] = s[0] + counts[key][1], s[1] + counts[key][2]
    out = {}
    for key, t in at.items():
        p = purity(*sums[key[0], tuple(t)])
        out[key] = ("/".join(t), round(p, 9), "block" if p < floor * share else "allow")
    return out


def draw(number, seed=7):
    """A number from 0 to 1 for an id: two rounds of the 64-bit hash, its low 52 bits."""
    h = xxhash.xxh64_intdigest(number.to_bytes(8, "little", signed=True), 42)
    return (xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h) & (1 << 52) - 1) / (1 << 52)
