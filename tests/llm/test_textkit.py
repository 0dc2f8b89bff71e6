import numpy as np

from kontor.llm import textkit as K


def test_patterned_texts_have_hashes_of_their_own():
    """A Thue-Morse word and its complement collide under every polynomial modulo 2**64."""
    order = [0]
    for _ in range(10):
        order += [1 - x for x in order]
    a = np.array(order, np.uint8) + 97
    b = 195 - a
    whole = [int(K.RangeHash(x)(np.array([0]), np.array([1024]))[0]) for x in (a, b)]
    joined = K.RangeHash(np.concatenate((a, b)))(np.array([0, 1024]), np.array([1024, 2048]))
    assert whole[0] != whole[1] and whole == joined.tolist()


def test_equal_ranges_hash_alike_wherever_they_are():
    data = np.random.default_rng(5).integers(0, 256, 5000).astype(np.uint8)
    start = np.arange(100)
    for kind in (K.RangeHash, K.WrappingHash):
        whole, part = kind(data), kind(data[700:900])
        assert (whole(start + 700, start + 800) == part(start, start + 100)).all()
        assert len(np.unique(whole(np.arange(4900), np.arange(4900) + 16))) == 4900
    whole = K.WrappingHash(data)
    assert (whole.fixed(100) == whole(np.arange(4901), np.arange(4901) + 100)).all()
    assert len(K.WrappingHash(data[:5]).fixed(16)) == 0


def test_long_buffers_hash_alike():
    data = np.random.default_rng(6).integers(0, 256, (1 << 24) + 50).astype(np.uint8)
    at = np.array([3, 900])
    assert (K.RangeHash(data)(at, at + 77) == K.RangeHash(data[:2000])(at, at + 77)).all()
