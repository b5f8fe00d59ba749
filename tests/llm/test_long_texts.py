"""Long texts are read in pieces: the same results, and memory and time that stay bounded."""

import subprocess
import sys
import time

import numpy as np
import pytest
from conftest import ROOT

from cohortis.llm import common, quality, shingles, simhash, toxicity


def some_text(rng, n):
    parts = ["word", "Word", "été", "ÀB", "1d10t", "x" * 40, ",", "漢字", "\x00", "trash can", "idiot"]
    gaps = [" ", "\n", "  ", "\t", " \r\n"]
    return "".join(str(rng.choice(parts)) + str(rng.choice(gaps)) for _ in range(n)).encode()


def test_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 4, 5, 7, 30, 300):
        for _ in range(6):
            text = b" \n" * int(rng.integers(0, 3)) + some_text(rng, n)
            for most in (16, 64, 333):
                assert simhash.fingerprint(text, most) == simhash.fingerprint(text, 1 << 30)
                assert shingles.codes_of(text, most).tolist() == shingles.sets_of([text])[1].tolist()
                long, short = shingles.sketch_of_long(text, most), shingles.sketches([text])
                assert all(a.tolist() == b.tolist() for a, b in zip(long, short, strict=True))
                if text:
                    assert quality._features_of_long(text, most) == pytest.approx(quality.features(text))


def test_scores_of_parts(monkeypatch):
    rng = np.random.default_rng(6)
    model = toxicity.Model({"idiot": 3.0, "trash": 2.0, "foo bar": 1.5}, {"idio": 1.0, "scum": 2.5})
    parts = ["idiot", "1d10t", "trash can", "trash", "can", "clown fish", "foo bar", "foo", "bar", "scumbag", "i​diot", "ΣΑΣ", "stupid simple", "circus clown", "IDIOTS"]
    for _ in range(200):
        text = "".join(str(rng.choice(parts)) + str(rng.choice([" ", "\n", "  ", "-", " "])) for _ in range(40))
        want = model.features(text)
        for most in (1, 7, 50):
            monkeypatch.setattr(common, "PIECE", most)
            assert model.features(text) == pytest.approx(want)
            monkeypatch.undo()


def test_time_grows_with_length():
    model = toxicity.Model({"idiot": 3.0, "trash": 2.0}, {})
    began = time.perf_counter()
    assert model.features("trash can idiot " * 65_536)[2] == pytest.approx(np.log1p(65_536))
    assert time.perf_counter() - began < 4


@pytest.mark.parametrize("what", ["simhash.fingerprint(t)", "shingles.sketch_of_long(t)", "quality.features(t)", "toxicity.Model({'idiot': 3.0}, {}).features(t.decode())"])
def test_memory_of_a_long_text(what):
    """Over 24 MB of text: the peak stays under 6 bytes a byte of it, and what a worker has anyway."""
    code = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
from cohortis.llm import common, quality, shingles, simhash, toxicity
import xxhash
t = bytearray()
for i in range(1_000_000):
    t += b"w%d and idiot%d, then.\\n" % (i % 9973, i)
t = bytes(t)
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{what}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / (len(t) / 1024))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    assert float(done.stdout) < 6, done.stdout
