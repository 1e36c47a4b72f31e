"""Brute-force licence scan in plain Python."""

import re

from kinweave.llm.license_scan import BASE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(text, signatures, base=BASE):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, phrase, label) for phrase, label in base for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    padded = f" {' '.join(words)} " if words else " "
    spans = []
    for n, label, keyword, expression, priority in signatures:
        if keyword in padded:
            for m in re.finditer(rf"(?<= )(?:{expression})(?= )", padded):
                start = padded[: m.start()].count(" ") - 1
                spans.append((start, start + m.group().count(" ") + 1, priority, n, label))
    kept = [s for s in spans if not any(o is not s and o[0] <= s[0] and o[1] >= s[1] and o[2] <= s[2] and ((o[0], o[1]) != (s[0], s[1]) or (o[2], o[3]) < (s[2], s[3])) for o in spans)]
    labels = {p[2] for p in places}
    covered = max(sum(len(p[1].split()) for p in places), sum(s[1] - s[0] for s in kept))
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min((p[0] for p in places), default=None), "last_word": max((p[0] for p in places), default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s[4] for s in kept})), "score": min(1.0, covered / max(len(words), 1)), "n_detections": len(kept),
    }
