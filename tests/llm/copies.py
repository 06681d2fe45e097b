"""The quality rules' removed lines, in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from stopwise.llm import quality

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub(r"\d+", "0", " ".join(TOKEN.findall(line.lower())))


def counted_as(texts):
    """What each distinct text of a host counts as: itself, or the name of its group of near copies."""
    held = {t: list(dict.fromkeys(x for x in (t or "").split("\n") if TOKEN.search(x))) for t in texts}
    times = Counter(x for lines in held.values() for x in lines)
    found = {}
    for text, lines in held.items():
        words = {x: len(TOKEN.findall(x)) for x in lines}
        digest = {x: hashlib.md5(x.encode()).hexdigest()[:16] for x in lines}
        common = sorted((times[x], digest[x], words[x]) for x in lines if times[x] > 1)
        total = sum(w for *_, w in common)
        found[text] = ("text", text)
        if common and total >= quality.COPY_SHARE * sum(words.values()):
            upto = 0
            for _, name, w in common:
                upto += w
                if 2 * upto >= total:
                    found[text] = ("copy", name)
                    break
    return found


def shared_lines(rows, least=quality.MIN_DOCUMENTS, growth=quality.GROWTH):
    """Per host the normalised lines that too many of its documents hold; rows are (host, text)."""
    texts = defaultdict(set)
    for host, text in rows:
        texts[host].add(text)
    shared = {}
    for host, own in texts.items():
        counted = counted_as(own)
        holding = defaultdict(set)
        for text in own:
            for line in (text or "").split("\n"):
                if TOKEN.search(line):
                    holding[normal(line)].add(counted[text])
        limit = max(least, growth * math.sqrt(len(set(counted.values()))))
        shared[host] = {line for line, documents in holding.items() if len(documents) > limit}
    return shared
