import random

from test_linededup import passage, run


def test_a_passage_goes_whole_though_an_earlier_document_holds_a_part(spark):
    rng, texts, wanted = random.Random(7), [], []
    for n, q in ((60, 35), (60, 45), (100, 45)) * 12:
        p = passage(rng, n).split()
        at = rng.randrange(n - q + 1)
        ends = [passage(rng, 30) for _ in range(6)]
        texts += [f"{ends[0]} {' '.join(p[at : at + q])} {ends[1]}", f"{ends[2]} {' '.join(p)} {ends[3]}", f"{ends[4]} {' '.join(p)} {ends[5]}"]
        wanted.append(f"{ends[4]} {ends[5]}".split())
    got = run(spark, texts)
    assert [got[3 * i + 2][0].split() for i in range(len(wanted))] == wanted
