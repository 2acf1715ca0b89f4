"""The counting and the threshold of disclosing terms again, in plain Python."""

import math
import random
import re

from casemesh.llm.disclosure import Disclosure, base_spans, disclosure_spans, entity_levels, listed
from helpers import clash, documents

TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def lowered(word):
    return re.sub("[A-Z]", lambda m: m.group().lower(), word)


def brute_force(texts, config=Disclosure()):
    both, held, said, near = {}, {}, {}, []
    for text in texts:
        text = text or ""
        spans = base_spans(text)
        terms = [(m.start(), m.end(), lowered(m.group())) for m in TERM.finditer(text)]
        free = [t for t in terms if all(t[1] <= low or t[0] >= high for _, low, high in spans)]
        pairs, entities = set(), set()
        for kind, low, high in spans:
            before = [t for t in terms if t[1] <= low][-config.near :]
            after = [t for t in terms if t[0] >= high][: config.near]
            for level in entity_levels(kind, text[low:high]):
                own = {(level, t[2]) for t in before + after if t in free}
                pairs |= own
                entities |= {level} if own else set()
        for pair in pairs:
            both[pair] = both.get(pair, 0) + 1
        for entity in entities:
            held[entity] = held.get(entity, 0) + 1
        for word in {t[2] for t in terms}:
            said[word] = said.get(word, 0) + 1
        near.append((text, spans, pairs, free))
    told = set()
    for (entity, word), n in both.items():
        worth = math.log2(len(texts) / held[entity])
        information = math.log2(len(texts) * n / (said[word] * held[entity]))
        if n >= config.support and worth > 0 and information >= config.share * worth - 1e-12:
            told.add((entity, word))
    out = []
    for text, spans, pairs, free in near:
        words = {word for entity, word in pairs if (entity, word) in told}
        added = [("term", low, high) for low, high, word in free if word in words]
        out.append(sorted(spans + added, key=lambda s: (s[1], s[0] != "term")))
    return out


def corpus():
    rng = random.Random(12)
    common = [f"Word{n}" for n in range(50)]
    hosts = ["site.org", "mail.example.net", "ähre.de"]
    texts = []
    for n in range(160):
        own = rng.choices(common, k=rng.randrange(0, 30))
        if n % 3 == 0:
            host = rng.choice(hosts[:2])
            own.insert(rng.randrange(len(own) + 1), f"Office{hosts.index(host)} p{n}@{host} Zörn")
        if n % 5 == 0:
            own.insert(rng.randrange(len(own) + 1), f"Server 10.{rng.randrange(2)}.{n}.7 rack{n % 2}")
        if n % 7 == 0:
            own.append(f"call +49 30 {1000000 + n} desk")
        texts.append(", ".join(own))
    return [*texts, None, "", texts[0], "🙂 a@b.co Zörn"]


def test_terms_are_those_of_the_plain_count(spark):
    texts = corpus()
    rows = disclosure_spans(clash(documents(spark, texts))).collect()
    want = brute_force(texts)
    for r in rows:
        got = [tuple(s) for s in r["spans"]]
        assert sorted(got) == sorted(want[r["doc_id"]]), listed(got)
    kinds = {kind for spans in want for kind, _, _ in spans}
    assert kinds == {"term", "email", "ip", "phone"}


def test_levels():
    assert entity_levels("email", "Ann@Site.ORG") == ("email:ann@site.org", "email<@site.org", "email")
    assert entity_levels("ip", "10.20.30.40") == ("ip:10.20.30.40", "ip<10.20", "ip")
    assert entity_levels("card", "4111 1111-1111 1111") == ("card:4111111111111111", "card<411111", "card")
    assert entity_levels("phone", "+49 (30) 123.456") == ("phone:4930123.456", "phone<4930", "phone")
