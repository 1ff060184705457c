"""The int32 dump of a hierarchy."""

import numpy as np
import pytest

from cutweave.model import Hierarchy
from cutweave.sources import dump


def graph(spark, edges, weights):
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges if a != b]
    return spark.createDataFrame(both, "src bigint, dst bigint, w bigint"), spark.createDataFrame(list(enumerate(weights)), "v bigint, vw bigint")


def test_dump_round_trip(spark, tmp_path):
    fine, coarse = graph(spark, [(0, 1, 1), (1, 2, 5), (2, 3, 10)], [1, 1, 1, 1]), graph(spark, [(0, 1, 5)], [2, 2])
    mapping = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "v bigint, c bigint")
    path = str(tmp_path / "h.bin")
    dump.write_dump(Hierarchy([fine, coarse], [mapping]), path)
    want = [2, 4, 6, 0, 1, 3, 5, 6, 1, 0, 2, 1, 3, 2, 1, 1, 5, 5, 10, 10, 1, 1, 1, 1, 2, 2, 0, 1, 2, 1, 0, 5, 5, 2, 2, 0, 0, 1, 1]
    assert np.fromfile(path, dtype="<i4").tolist() == want
    back = dump.read_dump(spark, path)
    for got, own in zip(back.graphs, [fine, coarse], strict=True):
        assert sorted(got[0].collect()) == sorted(own[0].collect()) and sorted(got[1].collect()) == sorted(own[1].collect())
    assert sorted(back.maps[0].select("v", "c").collect()) == sorted(mapping.collect())
    np.array(want[:-1], dtype="<i4").tofile(path)
    with pytest.raises(ValueError):
        dump.read_dump(spark, path)


def test_dump_rejects_what_it_cannot_hold(spark, tmp_path):
    wide = graph(spark, [(0, 1, 2**31)], [1, 1])
    for h in (Hierarchy([wide], []), Hierarchy([], []), Hierarchy([graph(spark, [(0, 1, 1)], [1, 1])] * 2, [])):
        with pytest.raises(ValueError):
            dump.write_dump(h, str(tmp_path / "x.bin"))
    assert not list(tmp_path.iterdir())
