"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
import zlib

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def shingle_set(text, width: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def jaccard_classes(rows) -> dict:
    """id to (set size, smallest id that links reach), by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return {i: (len(s), least[i]) for i, s in sets.items()}


def warc_rows(rows) -> dict:
    """id to (bytes, digest, type, refers to)."""
    payloads = {i: (h or "").encode() for i, h in rows}
    first = {}
    for i in sorted(payloads):
        first.setdefault(payloads[i], i)
    return {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit",
                None if first[p] == i else first[p]) for i, p in payloads.items()}


def top_k(rows, k: int = 5, every: int = 50) -> set:
    ints = {i: [int((256 * float(x)) // 1) for x in v] for i, v in rows}
    found = set()
    for q in ints:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:k]
            found |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return found


def water_targets(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Clamp and reshare until no source is above its cap."""
    left, free, targets = share * sum(sizes.values()), {s for s in sizes if sizes[s]}, dict.fromkeys(sizes, 0.0)
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > cap * sizes[s]}
        for s in over or free:
            targets[s] = cap * sizes[s] if over else level * weights[s]
        if not over:
            break
        left -= sum(targets[s] for s in over)
        free -= over
    return targets


def base_spans(text) -> list[tuple[str, int, int]]:
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def license_places(text, phrases: dict) -> tuple:
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    found = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    return (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None,
            ",".join(sorted({label for _, label in found})))


def edited_texts(rows) -> dict:
    """id to its edited text; the next document is that of the next id."""
    ordered = sorted((i, t or "") for i, t in rows)
    out = {}
    for n, (i, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        out[i] = text[:len(text) - half] + following[:half]
    return out


def best_fit(pieces, capacity: int) -> list[int]:
    """Bins of (size, source, cluster) pieces in order: the fullest bin without a conflict, the oldest on a tie."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fitting = [(b["room"], n) for n, b in enumerate(bins)
                   if b["room"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fitting:
            n = min(fitting)[1]
        else:
            n = len(bins)
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
        bins[n]["room"] -= size
        bins[n]["sources"].add(source)
        bins[n]["clusters"].add(cluster)
        out.append(n)
    return out


def order_audit(rows, labels) -> dict:
    """(part, order, step) to (kept, removed, redundant, unique, good, toxic, shapley), document by document.

    ``rows`` are (id, text, part), ``labels`` (id, quality, toxic).
    """
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and i > least[text]}
        docs.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                unique = sum(d[0] == part and d[1] == {f} for d in docs)
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [len(left), len(removed), sum(f in d[1] for d in gone), unique,
                                                   sum(d[2] for d in removed), sum(d[3] for d in removed)]
                gone += removed
                total[part, f] = total.get((part, f), 0) + len(removed)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def damaged_rows(rows) -> list:
    """(conv, turn, role, text) rows after the damage; rows that are dropped are left out."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest_edits(rows) -> tuple[int, str]:
    """Least (cost, letters) of ``rows``, pairs (initial, fault), by costs from every place to the end."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = None
    for i in range(len(rows), -1, -1):
        here = {q: (0, "") if i == len(rows) and q in ("", "a") else (10**9, "") for q in after}
        for _ in range(4):  # inserts lead to states of the same place
            for q, wanted in after.items():
                options = [(2, "I", here[wanted])]
                if i < len(rows):
                    initial, fault = rows[i]
                    options.append((3, "D", best[q]))
                    if fault not in ("blank", "duplicate"):
                        more = fault == "truncated"
                        options.append((2 + more, "R", best[wanted]))
                        if initial == wanted or (initial == "s" and q == ""):
                            options.append((more, "K", best[initial]))
                here[q] = min([here[q], *[(c + t[0], letter + t[1]) for c, letter, t in options]])
        best = here
    return best[""]


def repaired_conversations(rows) -> dict:
    """conv to (gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (conv, turn, role, text) rows."""
    after = damaged_rows(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        initials = [r[2][:1] for r in mine]
        cost, audit = cheapest_edits(list(zip(initials, faults)))
        kept, left, state = [], iter(mine), ""
        for letter in audit:
            wanted = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            role, text = (wanted, "") if letter == "I" else next(left)[2:]
            if letter != "D":
                kept.append(f"{role if letter == 'K' else wanted}:{text}")
                state = kept[-1][0]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def terms(text: str) -> set:
    """Words of letters, digits and characters beyond ASCII, and the first 4 and 5 characters of longer words."""
    found = set()
    for w in re.findall("[0-9A-Za-z\x80-\U0010FFFF]+", ascii_lower(text)):
        found |= {w} | {(n, w[:n]) for n in (4, 5) if len(w) > n}
    return found


def spark_hash(value, seed: int = 42) -> int:
    """Spark's xxhash64 of one value: an int as 4 bytes, ("long", n) as 8, a string as UTF-8; signed."""
    import xxhash

    if isinstance(value, tuple):
        raw = struct.pack("<q", value[1])
    else:
        raw = struct.pack("<i", value) if isinstance(value, int) else value.encode()
    return struct.unpack("<q", xxhash.xxh64(raw, seed=seed & (2**64 - 1)).digest()[::-1])[0]


def chained_hash(*values) -> int:
    """Spark's xxhash64 of several columns."""
    found = 42
    for v in values:
        found = spark_hash(v, found)
    return found


def imatch_prints(rows, rates, low_idf: float, high_idf: float, seed: int) -> dict:
    """Text to {subset: hash of its sorted list}, for all texts and edited texts of (id, text) rows."""
    import math

    def distinct(text):
        return {t for t in re.split(r"[^\w]+|_+", text.lower()) if t}

    df = {}
    for _, text in rows:
        for t in distinct(text or ""):
            df[t] = df.get(t, 0) + 1
    band = {t for t, n in df.items() if len(rows) * math.exp(-high_idf) <= n <= len(rows) * math.exp(-low_idf)}
    out = {}
    for text in [t or "" for _, t in rows] + list(edited_texts(rows).values()):
        lists = {}
        for t in distinct(text) & band:
            h = chained_hash(seed + 1, t) & ((1 << 57) - 1)
            for j, b in enumerate(rates):
                if chained_hash(seed, j, t) & ((1 << b) - 1) == 0:
                    lists.setdefault(j, []).append((j << 57) | h)
        out[text] = {}
        for j, keys in lists.items():
            found = 0
            for key in sorted(keys):
                found = chained_hash(("long", found), ("long", key))
            out[text][j] = found
    return out


def alignment_labels(text, templates, least: float) -> set:
    """Labels of the templates that stand in a text with all key phrases and enough of their words in order, by a full table."""
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    joined = f" {' '.join(w)} "
    found = set()
    for label, forms in templates.items():
        for form, keys in forms:
            t = form.split()
            if all(f" {k} " in joined for k in keys):
                row = [0] * (len(w) + 1)  # longest common subsequence
                for x in t:
                    row = list(itertools.accumulate(range(1, len(w) + 1), lambda left, i, row=row, x=x: max(
                        left, row[i], row[i - 1] + 1 if w[i - 1] == x else 0), initial=0))
                if row[-1] >= least * len(t):
                    found.add(label)
    return found


def odd_pairs(string: str, common) -> int:
    """Neighbours that are neither two digits nor a pair common in prose, a capital after a small letter being odd."""
    n = 0
    for a, b in zip(string, string[1:]):
        if a.isdigit() and b.isdigit():
            continue
        if (a + b).lower() in common and not (a.islower() and b.isupper()):
            continue
        n += 1
    return n


def step_up(p_values, rate: float) -> int:
    """How many hypotheses the rule of Benjamini and Hochberg rejects."""
    ordered = sorted(p_values)
    return max([k for k, p in enumerate(ordered, 1) if p <= rate * k / len(ordered)], default=0)


def attention_score(model, features) -> float:
    """Forward pass of one document, passage by passage."""
    import math

    w = model.weights
    logits, hidden = [], []
    for row in features:
        x = [(float(v) - float(m)) / float(s) for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(x[i] * w["W"][i][j] for i in range(len(x))) + w["b"][j]) for j in range(len(w["b"]))]
        e = 0.0
        for g in range(len(w["a"])):
            v = math.tanh(sum(h[i] * w["V"][i][g] for i in range(len(h))) + w["vb"][g])
            u = 1 / (1 + math.exp(-(sum(h[i] * w["U"][i][g] for i in range(len(h))) + w["ub"][g])))
            e += w["a"][g] * v * u
        logits.append(e)
        hidden.append(h)
    top = max(logits)
    share = [math.exp(e - top) for e in logits]
    z = sum(a / sum(share) * sum(h[j] * w["c"][j] for j in range(len(h))) for a, h in zip(share, hidden)) + w["d"][0]
    return 1 / (1 + math.exp(-z))
