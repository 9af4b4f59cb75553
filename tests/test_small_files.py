"""A task of the image source is bounded by the number of its files too, however small they are."""

from voxelake.sources.image_source import OPEN, ImageReader


def test_opening_counts(tmp_path):
    for n in range(40):
        (tmp_path / f"{n:02d}").write_bytes(bytes(200))
    for pixels in ("true", "false"):
        parts = [p.paths for p in ImageReader({"path": f"file://{tmp_path}", "splitbytes": str(3 * (OPEN + 200)), "pixels": pixels}).partitions()]
        assert max(map(len, parts)) == 3
        assert [p.rsplit("/", 1)[-1] for part in parts for p in part] == [f"{n:02d}" for n in range(40)]
