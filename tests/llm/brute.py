"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def op3(docs, bench):
    item_words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for i, t in bench}
    windows = {}
    for i, w in item_words.items():
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= got
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def op10(docs, sp):
    out = []
    for d, t in docs:
        ids = sp.encode(t or "") + [sp.eos_id()]
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def op5(docs):
    """(doc_id, counts, base_sha256)"""
    out = []
    for d, t in docs:
        spans, counts = [], []
        for rank, (kind, pattern) in enumerate(PII):
            n = 0
            for m in re.finditer(pattern, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {
                    "email": lambda: True,
                    "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15,
                }[kind]()
                if ok:
                    n += 1
                    spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
            counts.append(n)
        out.append((d, *counts, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest()))
    return out


def op8(rows):
    """rows: (conv_id, turn, role, text), conversation -1 included."""
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n, r or "", t or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def op9(docs):
    """(doc_id, n_chars, edited_sha256)"""
    docs = sorted((d, t or "") for d, t in docs)
    out = []
    for i, (d, t) in enumerate(docs):
        k = len(t) // 4
        edited = t[: len(t) - k] + docs[(i + 1) % len(docs)][1][:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def op1(docs, n=4, percent=85):
    """(doc_id, n_shingles, component_id, n_links)"""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    posts = {}
    for i, s in enumerate(sets):
        for x in s:
            posts.setdefault(x, []).append(i)
    root = list(range(len(docs)))
    links = [0] * len(docs)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in posts[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(s), least[find(i)], links[i]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def op2(docs, m=2):
    """(doc_id, n_lines, n_removed, kept_sha256)"""
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    seen, out = {}, []
    for i in order:
        d, t = docs[i]
        lines = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(lines) - m + 1):
            run = tuple(lines[k : k + m])
            if run in seen:
                gone.update(range(k, k + m))
            else:
                seen[run] = (d, k)
        kept = [x for k, x in enumerate(lines) if k not in gone]
        out.append((d, len(lines), len(gone), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def op7(docs, width=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    texts = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in texts:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if first.get(w, d) >= d:
                first[w] = d
    out = []
    for d, b in texts:
        gone = bytearray(len(b) + 1)
        end = 0
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < d:
                for i in range(max(k, end), k + width):
                    gone[i] = 1
                end = k + width
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = sum(gone[i] and not gone[i + 1] for i in range(len(b)))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def op13(docs, tokenizer, sp, kind="ends"):
    """docs: (doc_id, text); links by comparing every A token with every B token of a text."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    rows, corpus = [], {}
    for d, t in docs:
        a = b = []
        if t:
            whole = (" " + t).encode()
            a = [(i, bytes(byte[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(t))]
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = []

        def spans(tokens):
            out, at = [], 0
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        sa, sb = spans(a), spans(b)
        groups, ga, gb, ia, ib = [], [], [], 0, 0
        while ia < len(sa) or ib < len(sb):
            if ib >= len(sb) or (ia < len(sa) and sa[ia][2] <= sb[ib][2]):
                ga.append(sa[ia])
                ia += 1
            else:
                gb.append(sb[ib])
                ib += 1
            if ga and gb and ga[-1][2] == gb[-1][2]:
                groups.append((ga, gb))
                ga, gb = [], []
        found = []
        for x, y in groups:
            for i, s1, e1 in x:
                for j, s2, e2 in y:
                    if kind == "products" or (kind == "ends" and e1 == e2) or (kind == "overlaps" and s1 < e2 and s2 < e1):
                        found.append((i, j))
        for pair in found:
            corpus[pair] = corpus.get(pair, 0) + 1
        told = ";".join(",".join(str(t[0]) for t in x) + "|" + ",".join(str(t[0]) for t in y) for x, y in groups)
        rows.append((d, len(sa), len(sb), len(groups), found, hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    most = {}
    for (_, j), n in corpus.items():
        most[j] = max(most.get(j, 0), n)
    return [(d, na, nb, ng, len(f), sum(corpus[p] == most[p[1]] for p in f), sum(corpus[p] for p in f), sha) for d, na, nb, ng, f, sha in rows], corpus


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def op11(docs, least=7):
    import zlib

    n = {}
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= least and k > 1}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n]


def op12(docs, window=20):
    """docs: (doc_id, order, text); rows with the same doc_id and text are one document."""
    last = (1 << 63) - 1
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, out = {}, {}
    for d, o, t in sorted({(last if d is None else d, o, t or "") for d, o, t in docs}):
        w = cut(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), (d, o, i)) != (d, o, i):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d, o] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return [(d, *out[last if d is None else d, o]) for d, o, _ in docs]
