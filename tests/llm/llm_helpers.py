"""Plain versions to compare with."""

import hashlib


def brute_repeats(docs, length):
    """``n_bytes, n_removed, n_spans, kept_sha256`` of each id, by a table of all strings."""
    least = {}
    for i, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p:p + length]
            least[g] = min(least.get(g, i), i)
    out = {}
    for i, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def read_back(rows):
    """Ids and lengths of the documents that the pieces make up."""
    out = []
    by = {}
    for r in rows:
        by.setdefault(str(r.doc_id), []).append(r)
    for d, own in by.items():
        own.sort(key=lambda r: (r.piece, r.start))
        for first in [r for r in own if r.piece == 0]:
            out.append([d, first.length])
        heads = [x for x in out if x[0] == d]
        for k, r in enumerate([r for r in own if r.piece > 0]):
            heads[k % len(heads)][1] += r.length
    return sorted((d, n) for d, n in out)
