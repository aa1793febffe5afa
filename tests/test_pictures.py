"""Picture numbers against plain loops, and the picture model from files to filled rows."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickyard.functions import fixed
from brickyard.operators import models
from brickyard.plans import photo_model
from brickyard.sources import listings, pictures


def png(path, rgb):
    """A PNG of bytes (h, w, 3 or 1), written by hand."""
    h, w, c = rgb.shape
    raw = b"".join(b"\0" + rgb[k].tobytes() for k in range(h))

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def jpeg(spark, path, rgb):
    """A JPEG written by the JVM."""
    jvm = spark._jvm
    h, w, _ = rgb.shape
    flat = [(int(r) << 16) | (int(g) << 8) | int(b) for r, g, b in rgb.reshape(-1, 3)]
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)
    line = spark.sparkContext._gateway.new_array(jvm.int, w)
    for y in range(h):
        for x in range(w):
            line[x] = flat[y * w + x]
        picture.setRGB(0, y, w, 1, line, 0, w)
    path.parent.mkdir(parents=True, exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(path)))


def loop_resize(px, size):
    """Cubic convolution, pixel by pixel, along rows and then along columns."""

    def cubic(x):
        x = abs(x)
        return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0

    def line(values):
        n = len(values)
        if n == size:
            return values
        scale = n / size
        wide, out = max(scale, 1.0), []
        for k in range(size):
            c = (k + 0.5) * scale
            a, b = max(int(c - 2 * wide + 0.5), 0), min(int(c + 2 * wide + 0.5), n)
            w = [cubic((i - c + 0.5) / wide) for i in range(a, b)]
            w = [x / sum(w) for x in w]
            w = [int(x * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w]
            out.append([min(255, max(0, (sum(w[i - a] * values[i][ch] for i in range(a, b)) + 2**21) >> 22)) for ch in range(3)])
        return out

    rows = [line([list(map(int, p)) for p in row]) for row in px]
    columns = [line([rows[y][x] for y in range(len(rows))]) for x in range(size)]
    return np.array([[columns[x][y] for x in range(size)] for y in range(size)], np.uint8)


def loop_features(px):
    """Every number by loops over the pixels of a square picture."""
    n = len(px)
    flat = [tuple(map(int, p)) for row in px for p in row]
    share = [[np.float32(v) / np.float32(255) for v in p] for p in flat]
    again = [[int(s * np.float32(255)) for s in p] for p in share]

    def mean(v):
        return math.fsum(v) / len(v)

    def var(v):
        m = mean(v)
        return math.fsum((x - m) ** 2 for x in v) / len(v)

    out = [mean([float(p[k]) for p in share]) for k in range(3)] + [math.sqrt(var([float(p[k]) for p in share])) for k in range(3)]
    top, low = [max(p) for p in again], [min(p) for p in again]
    sat = [((t - b) * (round((255 << 12) / t) if t else 0) + 2048) >> 12 for t, b in zip(top, low)]
    for v in (sat, top):
        v = [x / 255 for x in v]
        out += [mean(v), math.sqrt(var(v))]
    gray = [(9798 * r + 19235 * g + 3735 * b + 16384) >> 15 for r, g, b in again]
    at = lambda y, x: gray[min(max(y, 0), n - 1) * n + min(max(x, 0), n - 1)]
    out += [mean([g / 255 for g in gray]), math.sqrt(var([g / 255 for g in gray]))]
    dx, dy = {}, {}
    for y in range(n):
        for x in range(n):
            dx[y, x] = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            dy[y, x] = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    size = {p: abs(dx[p]) + abs(dy[p]) for p in dx}
    weak = set()
    for (y, x), m in size.items():
        ax, ay = abs(dx[y, x]), abs(dy[y, x]) << 15
        if m <= 80:
            continue
        get = lambda a, b: size.get((y + a, x + b), 0)  # noqa: B023, E731
        if ay < ax * 13573:
            ok = m > get(0, -1) and m >= get(0, 1)
        elif ay > ax * 13573 + (ax << 16):
            ok = m > get(-1, 0) and m >= get(1, 0)
        else:
            s = 1 if (dx[y, x] < 0) == (dy[y, x] < 0) else -1
            ok = m > get(-1, -s) and m > get(1, s)
        if ok:
            weak.add((y, x))
    stack = [p for p in weak if size[p] > 160]
    found = set(stack)
    while stack:
        y, x = stack.pop()
        for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            if p in weak and p not in found:
                found.add(p)
                stack.append(p)
    out.append(len(found) / n**2)
    r = lambda k: -k if k < 0 else 2 * n - 2 - k if k >= n else k
    curve = [sum(gray[r(y + a) * n + r(x + b)] for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))) - 4 * gray[y * n + x] for y in range(n) for x in range(n)]
    out += [var(curve) / 10_000, mean([g < 45 for g in gray]), mean([g > 215 for g in gray]), mean([np.float32(s) / np.float32(255) < np.float32(0.12) for s in sat])]
    rg, yb = [abs(float(p[0]) - float(p[1])) for p in share], [abs((float(p[0]) + float(p[1])) / 2 - float(p[2])) for p in share]
    out.append(math.sqrt(var(rg) + var(yb)) + 0.3 * math.sqrt(mean(rg) ** 2 + mean(yb) ** 2))
    out.append(-sum(gray.count(t) / n**2 * math.log2(gray.count(t) / n**2) for t in set(gray)) / 8)
    for k in range(3):
        out += [sum(min(p[k] * 8 // 255, 7) == b for p in flat) / n**2 for b in range(8)]
    return out


def scene(seed, h, w):
    """Blocks, a gradient, a line and noise."""
    draw = np.random.default_rng(seed)
    a = np.zeros((h, w, 3))
    a += np.linspace(0, 255, w)[None, :, None] * draw.random(3)
    for _ in range(6):
        y, x = int(draw.integers(h)), int(draw.integers(w))
        a[y : y + h // 3, x : x + w // 3] = draw.integers(0, 256, 3)
    a += draw.normal(0, 6, a.shape)
    return np.clip(a, 0, 255).astype(np.uint8)


def test_numbers_equal_loops(spark, tmp_path):
    made = {"wide.png": scene(1, 40, 300), "small.png": scene(2, 30, 20), "same.png": scene(3, 224, 224), "flat.png": np.full((50, 60, 3), 255, np.uint8), "black.png": np.zeros((10, 10, 3), np.uint8)}
    for name, px in made.items():
        png(tmp_path / "7" / name, px)
    gray = scene(4, 60, 80)[:, :, :1].copy()
    png(tmp_path / "7" / "gray.png", gray)
    made["gray.png"] = np.repeat(gray, 3, axis=2)
    (tmp_path / "7" / "broken.png").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r for r in pictures.read_pictures(spark, str(tmp_path), "*.png").collect()}
    assert set(got) == {*made, "broken.png"} and got["broken.png"].features is None and got["broken.png"].width is None
    assert len(fixed.PICTURE_FEATURES) == 43 and (got["wide.png"].width, got["wide.png"].height) == (300, 40)
    for name, px in made.items():
        want = loop_features(loop_resize(px, 224))
        for k, v in enumerate(fixed.PICTURE_FEATURES):
            assert got[name].features[k] == pytest.approx(want[k], abs=1e-9), (name, v)


def test_jpeg_pictures_are_decoded_by_spark(spark, tmp_path):
    px = scene(5, 90, 120)
    jpeg(spark, tmp_path / "1" / "a.jpg", px)
    row = spark.read.format("image").load(str(tmp_path / "1")).select("image.*").first()
    seen = pictures.pixels_of(row.height, row.width, row.nChannels, bytes(row.data))
    assert np.abs(seen.astype(int) - px).mean() < 12
    got = pictures.read_pictures(spark, str(tmp_path)).first().features
    assert got == pytest.approx(loop_features(loop_resize(seen, 224)), abs=1e-9)
    assert got == pytest.approx(pictures.features(pictures.resized(px)), abs=0.2)


def test_small_pictures_are_not_kept(spark):
    rows = spark.createDataFrame([("a", 160, 120), ("b", 159, 400), ("c", 400, 119), ("d", None, None)], "path string, width int, height int")
    assert [r.path for r in pictures.large_enough(rows).collect()] == ["a"]


ROWS = "ord int, `№` string, `ремонт` string, `опис` string, url string"


def numpy_fit(x, y, classes):
    """The balanced, regularised softmax fit by plain gradient steps."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = (x - mean) / scale
    hot = np.eye(len(classes))[[classes.index(c) for c in y]]
    weight = (len(y) / (len(classes) * hot.sum(0)))[hot.argmax(1)]
    w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
    for _ in range(3000):
        s = z @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - hot) * weight[:, None]
        w -= 0.02 * (z.T @ d / len(y) + w / len(y))
        b -= 0.02 * d.mean(0)
    return lambda q: (((q - mean) / scale) @ w + b).argmax(1)


def test_model_from_files_to_rows(spark, tmp_path):
    draw = np.random.default_rng(3)
    looks = {"євроремонт": 230, "радянський ремонт": 120, "під ремонт": 30}
    rows, kind = [], {}
    for k in range(30):
        name = list(looks)[k % 3]
        kind[k] = name
        said = name if k < 18 and k % 2 else ""
        rows.append((k, f"№ {k}", said, f"тут {name}" if k < 18 and not said else "", "https://x.example"))
        for j in range(5 if k == 2 else 2):
            px = np.clip(draw.normal(looks[name], 14, (24, 32, 3)), 0, 255).astype(np.uint8)
            png(tmp_path / str(k) / f"{j}.jpg", px if j < 4 else 255 - px)
    rows += [(30, "№ 30", "", "", ""), (31, None, "", "", ""), (32, "№ 32", "", "", ""), (33, "№ 33", "власний", "", "")]
    kind |= {31: "євроремонт", 33: "під ремонт"}
    for k, light in (("unknown", 230), ("33", 30)):
        png(tmp_path / k / "a.jpg", np.clip(draw.normal(light, 14, (24, 32, 3)), 0, 255).astype(np.uint8))
    (tmp_path / "32").mkdir()
    (tmp_path / "32" / "a.jpg").write_bytes(b"broken")
    table = spark.createDataFrame(rows, ROWS)
    seen = pictures.read_pictures(spark, str(tmp_path)).cache()
    manual = spark.createDataFrame([("№ 29", "під ремонт")], "row_id string, label string")
    model = photo_model.train(table, seen, manual)
    assert model["classes"] == sorted(looks) and model["training"] == {"labeled_rows": 19, "manual_labeled_rows": 1, "photo_samples": 40, "training_accuracy": 1.0}
    # The same classes as a plain fit on the same pictures.
    labelled = photo_model.labelled_rows(table, manual)
    own = pictures.pictures_of_rows(labelled, seen, 4).join(labelled.select("ord", "label"), "ord").collect()
    predict = numpy_fit(np.array([r.features for r in own]), [r.label for r in own], model["classes"])
    every = seen.where("features is not null").select("path", "features", models.linear_scores(F.col("features"), model["mean"], model["scale"], model["coef"], model["intercept"]).alias("p")).collect()
    assert [int(np.argmax(r.p)) for r in every] == predict(np.array([r.features for r in every])).tolist()
    # Written, read again and applied.
    listings.write_model(photo_model.model_table(spark, model), str(tmp_path / "model"))
    again = photo_model.model_of(listings.read_model(spark, str(tmp_path / "model"), photo_model.KIND))
    judged = photo_model.judge(table, seen, again)
    got = {r.ord: r for r in judged.collect()}
    status = {k: "kept" if rows[k][2] else "updated" for k in range(34)} | {30: "no images", 32: "no images"}
    assert {k: r.status for k, r in got.items()} == status
    assert all(got[k].label == kind[k] and got[k].confidence >= 0.62 for k, s in status.items() if s == "updated")
    after = {r.ord: r["ремонт"] for r in photo_model.fill_repairs(table, judged).collect()}
    assert after == {k: kind[k] if s == "updated" else rows[k][2] for k, s in status.items()}
    assert photo_model.judge(table, seen, again, overwrite=True).where("ord = 33").first().label == "під ремонт"
    assert photo_model.judge(table, seen, again, least=1.1).where("status = 'updated'").count() == 0
    with pytest.raises(ValueError, match="kind"):
        photo_model.model_of(spark.createDataFrame([("x",)], "kind string"))
    with pytest.raises(ValueError, match="not enough"):
        photo_model.train(table.where("ord < 2"), seen)
    seen.unpersist()
