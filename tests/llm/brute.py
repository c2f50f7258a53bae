"""Plain single-machine versions to compare with."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(UPPER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def components(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = []
    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            links.append((a, b))
    root = roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least[r] if i is not None else None) for (i, _), s, r in zip(rows, sets, root, strict=True)]


def line_key(line):
    return low(line.strip(BLANKS))


def dedup_lines(rows, least=10):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if line_key(line):
                holders[line_key(line)].add(i if i is not None else ("null", t))
    common = {k for k, v in holders.items() if len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) not in common]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return out


ASSIGN = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def secrets(rows):
    """rows: (doc_id, text, owner). Base spans as in the contract, opaque ones by counting owners."""
    base, opaque, owners = [], [], defaultdict(set)
    for _, t, owner in rows:
        t = t or ""
        found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base.append(sorted(found))
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)]
        more = [s for s in more if re.search("[0-9]", s[3]) and re.search("[A-Za-z]", s[3])]
        opaque.append([s for s in more if not any(b[0] < s[2] and s[0] < b[2] for b in found)])
        for s in base[-1] + opaque[-1]:
            owners[s[3]].add(owner)
    names = ["assign", "access", "hex", "opaque"]

    def text(spans):
        return ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))

    out = []
    for (i, _, _), b, o in zip(rows, base, opaque, strict=True):
        counts = Counter(names[s[1]] for s in b)
        added = [s for s in o if len(owners[s[3]]) < 3]
        digest = hashlib.sha256(text(b).encode()).hexdigest()
        out.append((i, counts["assign"], counts["access"], counts["hex"], digest, text(b + added)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted_words(doc_id, text):
    """The words of a text, repeated to the end for one id in ten."""
    w = word_list(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def runs_of(w):
    """(start, length, period) of every maximal run, by definition: each period, each maximal stretch."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def run_row(doc_id, w):
    runs = runs_of(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    rest = " ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def damaged_turns(rows):
    """rows: (conv_id, turn, role, text). The damaged rows of each conversation, in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c]
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate({ord(x): None for x in ".!?"}) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[c] += [(t, role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of one conversation: all suffixes, from the end."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(BLANKS)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "fine" if last in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    # Best (cost, letters, lines) from row i on, for each text of initials so far that matters: "", "s", "u", "a".
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            _, role, text = rows[i]
            after, best = best, {}
            for state in ("", "s", "u", "a"):
                ways = [(3, "D", (), state)]
                if faults[i] in ("fine", "truncated"):
                    extra = faults[i] == "truncated"
                    ways += [(2 + extra, "R", (f"{new}:{text}",), step[state, new[0]]) for new in ("user", "assistant") if (state, new[0]) in step]
                    if (state, initials[i]) in step:
                        ways.append((int(extra), "K", (f"{role}:{text}",), step[state, initials[i]]))
                ways = [(c + after[e][0], x + after[e][1], y + after[e][2]) for c, x, y, e in ways if e in after]
                if ways:
                    best[state] = min(ways)
        changed = True
        while changed:
            changed = False
            for state in ("", "s", "u", "a"):
                for new in ("user", "assistant"):
                    end = best.get(step.get((state, new[0])))
                    if end:
                        way = (2 + end[0], "I" + end[1], (f"{new}:",) + end[2])
                        if state not in best or way[:2] < best[state][:2]:
                            best[state], changed = way, True
    cost, audit, lines = best[""]
    counts = Counter(faults)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


def target_mix(rows, weights=(3, 1, 2), block=32):
    """rows: (doc_id, text, source). (doc_id, size, source_size, target, taken, source) of each."""
    sizes = [(i, len(word_list(t)), s) for i, t, s in rows]
    total = Counter()
    for _, n, s in sizes:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, rest, left = {}, set(names), sum(total.values()) * 3 / 2
    while rest:
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} if over else share
        left -= sum(2 * total[s] for s in over)
        rest = rest - set(over) if over else set()
    whole = sum(total.values()) * 3 / 2
    drawn, bounds, high = Counter(), [], 0.0
    for s in names:
        bounds.append((high, high + target[s], s))
        high += target[s]
    for k in range(-(-int(whole) // block)):
        x = ((k + 1) * 0.6180339887498949 % 1.0) * whole
        drawn[next((s for a, b, s in bounds if a <= x < b), [s for a, b, s in bounds if b > a][-1])] += block
    out, place = [], Counter()

    def order(r):
        key = " " if r[0] is None else str(r[0])
        return (int(hashlib.md5(key.encode()).hexdigest()[:8], 16), r[0] is not None, r[0] or 0, r[1])

    for i, n, s in sorted(sizes, key=order):
        a = place[s]
        place[s] += n
        taken = sum(max(0, min(a + n + e * total[s], drawn[s]) - a - e * total[s]) for e in (0, 1))
        out.append((i, n, total[s], target[s], taken, s))
    return out
