"""Keys, labels and paths as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Method families and their members.
FAMILIES = {"organic": ("view", "real"), "commerce": ("click", "purchase"), "account": ("signup",), "fault": ("error",)}
#: The families of forgery methods. The last one is held out as unknown when detectors are trained.
TAXONOMY = {"FS": ("simswap", "faceswap", "blendface"), "FR": ("wav2lip", "sadtalker", "fomm"), "EFS": ("StyleGAN2", "VQGAN", "ddim"), "FE": ("stargan", "starganv2", "styleclip")}
UNKNOWN_FAMILIES = ("FE",)


def label_from_method(method: Column, label: Column | None = None, real: str = "real") -> Column:
    """An explicit label wins; else 0 for the real method and 1 for any other."""
    own = F.when(method == real, 0).otherwise(1)
    return own if label is None else F.coalesce(label.cast("int"), own)


def label_from_category(category: Column, labels: dict[str, int]) -> Column:
    """The label of a folder's category, upper and lower case alike; null for a category without one."""
    known = F.create_map(*(F.lit(x) for k, v in labels.items() for x in (k.lower(), v)))
    return F.try_element_at(known, F.lower(category))


def label_invert(flag: Column) -> Column:
    return 1 - flag.cast("int")


def label_from_name(name: Column, fake: tuple[str, ...] = ("fake", "synth"), real: tuple[str, ...] = ("real", "orig")) -> Column:
    """1 if the file name has a fake token, 0 if it has a real one and no fake one, else null."""
    low, no = F.lower(name), F.lit(False)
    has = lambda tokens: [low.contains(t) for t in tokens]
    return F.when(reduce(or_, has(fake), no), 1).when(reduce(or_, has(real), no), 0)


def identity_last_match(text: Column, pattern: str) -> Column:
    """The last match of ``pattern``, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))


def identity_pair_first(text: Column) -> Column:
    """A for A_B with digits on both sides, else the text itself."""
    return F.when(text.rlike(r"^\d+_\d+$"), F.split(text, "_")[0]).otherwise(text)


def identity_from_frame(name: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(name, pattern, group)
    return F.when(found != "", found)


def source_key(method: Column, video: Column, folder: Column) -> Column:
    """Subject of a sample from whichever part of its place names one."""
    return (
        F.when(video.rlike(r"^id\d+_\d+"), F.concat(F.lit("c:"), F.regexp_extract(video, r"^(id\d+)", 1)))
        .when(video.rlike(r"^\d+_\d+$"), F.concat(F.lit("p:"), F.split(video, "_")[0]))
        .when(folder.rlike(r"^\d+_\d+$"), F.concat(F.lit("p:"), F.split(folder, "_")[0]))
        .when(folder.rlike(r"^\d+$"), F.concat(F.lit("n:"), folder))
        .when(method == "real", F.concat(F.lit("r:"), video))
        .otherwise(F.concat_ws(":", method, video))
    )


def video_stem(name: Column) -> Column:
    """A file name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")


def namespaced(domain: Column, identity: Column) -> Column:
    return F.concat_ws(":", domain, identity)


def path_safe(key: Column) -> Column:
    return F.regexp_replace(key, r"[^A-Za-z0-9._-]", "_")


def path_rewrite(path: Column, prefix: str, replacement: str) -> Column:
    return F.when(path.startswith(prefix), F.concat(F.lit(replacement), F.substring(path, len(prefix) + 1, 1 << 20))).otherwise(path)


def path_relayout(method: Column, path: Column) -> Column:
    """real/<file> or <method>/fake/<file>."""
    name = F.substring_index(path, "/", -1)
    return F.when(method == "real", F.concat(F.lit("real/"), name)).otherwise(F.concat_ws("/", method, F.lit("fake"), name))


def path_after(path: Column, anchor: str) -> Column:
    """The parts behind the first ``anchor``, null without it, empty if it is the last part."""
    parts = F.split(path, "/")
    at = F.array_position(parts, anchor)
    return F.when(at > 0, F.array_join(F.slice(parts, at.cast("int") + 1, F.size(parts)), "/"))


def path_folder(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def classify_source(name: Column) -> Column:
    """Kind of identifier by full match."""
    return (
        F.when(name.rlike(r"^id\d+_\d+$"), "celebrity")
        .when(name.rlike(r"^\d+_\d+$"), "pair")
        .when(name.rlike(r"^\d+$"), "number")
        .when(name.rlike(r"^(HQ|hq|LQ|lq)"), F.upper(F.substring(name, 1, 2)))
        .otherwise("other")
    )


def method_family(method: Column, families: Mapping[str, Sequence[str]] = FAMILIES) -> Column:
    """The family of a method, "other" for one in none."""
    out = F.lit("other")
    for family, members in families.items():
        out = F.when(method.isin(*members), family).otherwise(out)
    return out


def subject_prefix(stem: Column) -> Column:
    """What stands before the first "_" of a file stem, the stem itself without one."""
    return F.substring_index(stem, "_", 1)


def path_remap(path: Column, method: Column, rules: Mapping[str | None, Sequence[tuple[str, str]]]) -> Column:
    """``path`` with each method's (old, new) parts replaced, in order, after those of None, which hold for all methods."""
    out = path
    for old, new in rules.get(None, ()):
        out = F.replace(out, F.lit(old), F.lit(new))
    whole = out
    for name, parts in rules.items():
        if name is not None:
            own = whole
            for old, new in parts:
                own = F.replace(own, F.lit(old), F.lit(new))
            out = F.when(method == name, own).otherwise(out)
    return out


def error_type(label: Column, pred: Column) -> Column:
    return F.when((label == 1) & (pred == 1), "TP").when((label == 0) & (pred == 0), "TN").when(label == 1, "FN").otherwise("FP")


def decide(prob: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """1 where prob >= threshold (sweeps) or prob > threshold (detection rates)."""
    return (prob >= threshold if inclusive else prob > threshold).cast("int")


def safe_ratio(fake: Column, real: Column) -> Column:
    return fake / F.greatest(F.lit(1), real)


def crop_box(width: Column, height: Column) -> list[Column]:
    """Centre square: top, left, min_dim."""
    side = F.least(width, height)
    return [((height - side) / 2).cast("int").alias("top"), ((width - side) / 2).cast("int").alias("left"), side.alias("min_dim")]


def losses(label: Column, prob: Column, smoothing: float = 0.1, gamma: float = 2.0, floor: float = 1e-7) -> dict[str, Column]:
    """Negative log likelihood, label-smoothed cross entropy and focal loss of each row."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), prob))
    own = F.when(label == 1, p).otherwise(1 - p)
    nll = -F.log(own)
    smooth = (1 - smoothing) * nll - smoothing * (F.log(p) + F.log(1 - p)) / 2
    return {"nll": nll, "smoothed": smooth, "focal": F.pow(1 - own, F.lit(gamma)) * nll}
