"""Secret scans of long runs end in time that grows with the text, and find what is in them."""

import base64
import json
import random
import time

import pytest

pytest.importorskip("intervalia.llm")

from intervalia.llm import secret_scan  # noqa: E402


def took(text):
    began = time.perf_counter()
    secret_scan.base_spans(text)
    secret_scan.confirmed_spans(text)
    return time.perf_counter() - began


def seg(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


HEAD = "AAAAB3NzaC1yc2E"
TOKEN = seg({"alg": "HS256", "typ": "JWT"}), seg({"sub": "1234567890", "name": "x"}), "c2lnbmF0dXJlLW9mLXRva2Vu"
RUNS = ["AAAA/", "eyJ-", "M/", "MIIB/", "30aa-", "b3Bl/", HEAD + "/", "b3BlbnNzaC1rZXktdjEA/", "eyJhIjoxfQ-", "e_", "eyJhbGciOiJIUzI1NiJ9-", "AAAA", "a=", "eyJhIjoi-"]


@pytest.mark.parametrize("unit", RUNS)
@pytest.mark.parametrize("after", ["", ".aaaa.bbbb", f".{TOKEN[1]}.{TOKEN[2]}"])
def test_a_million_characters(unit, after):
    assert took(unit * (1_000_000 // len(unit)) + after) < 5


def ssh():
    field = lambda b: len(b).to_bytes(4, "big") + b
    r = random.Random(1)
    return base64.b64encode(field(b"ssh-rsa") + field(b"\1\0\1") + field(r.randbytes(257))).decode().rstrip("=")


@pytest.mark.parametrize("unit", ["AAAA/", "M/", "30aa-", "eyJ-"])
def test_found_after_a_long_run(unit):
    lead = unit * 20_000
    key, token = ssh(), ".".join(TOKEN)
    kind, a, e = secret_scan.confirmed_spans(f"{lead}{key}")[0]
    assert (kind, a, e) == ("ssh", len(lead), len(lead) + len(key))
    glue = lead if lead.endswith("-") else lead + "-"
    assert ("jwt", len(glue), len(glue) + len(token)) in secret_scan.confirmed_spans(f"{glue}{token}")


def plain(s, at):
    """Whether the JSON object of a whole part is sound."""
    return secret_scan.json_object(s[at:]) is not None


def test_heads_are_told_rightly():
    """What may_be_json rejects is no object, whatever is in it."""
    r = random.Random(2)
    values = [None, True, 1, -2.5e10, "x" * 60, 'q"\\\\é😀' * 9, {"a": [1, {"b": "c" * 50}]}, [[]] * 20, "", {"": {}}]
    for _ in range(3000):
        found = {"alg": "none"} | {f"k{r.randrange(99)}": r.choice(values) for _ in range(r.randrange(6))}
        raw = (json.dumps(found, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2, 40])) + " " * r.choice([0, 0, 3, 40])).encode(r.choice(["utf-8", "utf-8", "utf-16-le"]))
        s = base64.urlsafe_b64encode(raw).decode().rstrip("=")
        assert plain(s, 0) and secret_scan.may_be_json(s, 0)
        for at in range(1, min(len(s), 60)):
            assert secret_scan.may_be_json(s, at) or not plain(s, at)
