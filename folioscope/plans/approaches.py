"""The search approaches: which encoder reads what, and how a vector table is built."""

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..functions import vectors as U
from ..operators import corpus, embedtext as E
from ..sources import vectors as store
from ..sources.pages import relative_path

FROM_TEXT, FROM_PIXELS, FUSED = "text", "pixels", "fused"


@dataclass(frozen=True)
class Approach:
    """``image_from`` says what an image's vector is made of: its annotation text, its
    pixels, or the weighted sum of both."""

    approach_id: str
    text_model: str
    image_model: str
    image_from: str
    templates: object = field(default=None, hash=False)
    visual_weight: float = V.VISUAL_WEIGHT
    text_weight: float = V.TEXT_WEIGHT


@dataclass(frozen=True)
class Encoder:
    """Batch functions of a model as column functions; prefixes are for its texts."""

    text: Callable[[Column], Column]
    image: Callable[[Column], Column] = None
    passage_prefix: str = ""
    query_prefix: str = ""
    width: int = V.JOINT_WIDTH


REGISTRY = (
    Approach(V.APPROACH_TEXT_ONLY, V.TEXT_MODEL, V.TEXT_MODEL, FROM_TEXT),
    Approach(V.APPROACH_HYBRID, V.TEXT_MODEL, V.JOINT_MODEL, FUSED),
    Approach(V.APPROACH_JOINT, V.JOINT_MODEL, V.JOINT_MODEL, FROM_PIXELS),
    Approach(V.APPROACH_UNIFIED, V.JOINT_MODEL, V.JOINT_MODEL, FUSED, V.TEMPLATE_UNIFIED),
)


def registry_table(spark, registry=REGISTRY) -> DataFrame:
    rows = [
        (a.approach_id, a.text_model, a.image_model, a.image_from,
         "unified" if isinstance(a.templates, str) else "by_type", a.visual_weight, a.text_weight)
        for a in registry
    ]
    return spark.createDataFrame(
        rows,
        "approach_id string, text_model string, image_model string, image_from string, "
        "template string, visual_weight double, text_weight double",
    )


_ELEMENTS = {"float": T.FloatType(), "double": T.DoubleType()}


def with_configuration(df: DataFrame, registry=REGISTRY) -> DataFrame:
    """The configuration of each row's approach; unknown approaches get nulls. The
    registry is a handful of rows, so it is broadcast."""
    return df.join(F.broadcast(registry_table(df.sparkSession, registry)), "approach_id", "left")


class Inputs:
    """The texts and encoder outputs that approaches need, each distinct one once."""

    def __init__(self, encoders, content):
        self.encoders, self.content = encoders, content
        self.texts, self.vectors, self.names = {}, {}, {}

    def _name(self, key, table, column):
        if key not in self.names:
            self.names[key] = f"_{len(self.names)}"
            table[self.names[key]] = column()
        return self.names[key]

    def text(self, templates):
        key = templates if isinstance(templates, str) else "by type"
        return self._name(("text", key), self.texts, lambda: E.embedding_text(templates))

    def _vector(self, key, model, encode):
        encoder = self.encoders[model]
        return self._name(key, self.vectors, lambda: U.zero_if_missing(encode(encoder), encoder.width))

    def words(self, model, templates):
        text = self.text(templates)
        return self._vector(
            ("words", model, text), model, lambda e: e.text(E.prefixed(text, e.passage_prefix))
        )

    def pixels(self, model):
        return self._vector(("pixels", model), model, lambda e: e.image(F.col(self.content)))

    def text_vector(self, a):
        return U.l2_normalize(self.words(a.text_model, a.templates))

    def image_vector(self, a):
        """An image's vector under one approach. One failed half fails a fused vector."""
        if a.image_from == FROM_TEXT:
            return U.l2_normalize(self.words(a.image_model, a.templates))
        pixels = self.pixels(a.image_model)
        if a.image_from == FROM_PIXELS:
            return U.l2_normalize(pixels)
        words = self.words(a.image_model, a.templates)
        return F.when(
            (U.norm(pixels) > 0) & (U.norm(words) > 0),
            U.fuse(pixels, words, a.visual_weight, a.text_weight),
        ).otherwise(F.expr(f"array_repeat(0D, {self.encoders[a.image_model].width})"))

    def add_to(self, df):
        return df.withColumns(self.texts).withColumns(self.vectors)


def build(clean: DataFrame, encoders, registry=REGISTRY, content="content",
          element_type="float", cache=None) -> DataFrame:
    """Unit vectors of texts and images for every approach in ``registry``.

    Rows of other types take no part. Texts and images are two branches, so an encoder
    sees only its own rows; within a branch approaches share one scan, and an input that
    several of them encode with the same model is encoded once. A failed encode is a
    zero vector. With a ``cache`` (``plans.vector_cache``) only inputs that are new to it are
    encoded, here and now; equal inputs of different rows are encoded once, too.
    """
    others = [c for c in clean.columns if c != content]
    ids = F.array(*[F.lit(a.approach_id) for a in registry])

    def branch(kind, vector):
        inputs = Inputs(encoders, content) if cache is None else cache.inputs(encoders, content)
        text, vectors = F, F
        for a in registry:
            mine = F.col("approach_id") == a.approach_id
            text = text.when(mine, F.col(inputs.text(a.templates)))
            vectors = vectors.when(mine, getattr(inputs, vector)(a))
        # The unit vector is made after the rows are multiplied, so a reader without use for it
        # does not pay for it. The encoders of all entries run: give the registry entries that
        # are wanted (``only``), a filter afterwards comes too late.
        rows = inputs.add_to(clean.filter(F.col("type") == kind)).withColumn("approach_id", F.explode(ids))
        return rows.select(
            "approach_id", *others, text.alias("text_for_embedding"),
            vectors.cast(T.ArrayType(_ELEMENTS[element_type])).alias("vector"),
        )

    return branch("text", "text_vector").unionByName(branch("image", "image_vector"))


def with_image_bytes(clean: DataFrame, images: DataFrame, path="content_path", root="") -> DataFrame:
    """Image bytes next to the annotation; a missing file leaves null, which an encoder
    turns into the zero vector. Files are found by their path below ``root``, whichever form
    it has on either side. Images without a path get spread-out keys that match
    no file, as nulls would all meet in one task."""
    texts = clean.filter(F.col("type") != "image").withColumn("content", F.lit(None).cast("binary"))
    no_file = F.concat(F.lit("\u0000"), F.xxhash64("id"))
    wanted = clean.filter(F.col("type") == "image").withColumn("_file", F.coalesce(relative_path(path, root), no_file))
    files = images.select(relative_path("content_path", root).alias("_file"), "content")
    return texts.unionByName(wanted.join(files, "_file", "left").select(*texts.columns))


def only(*approach_ids, registry=REGISTRY):
    """The registry entries asked for. What the others read is then not encoded."""
    unknown = set(approach_ids) - {a.approach_id for a in registry}
    if unknown:
        raise ValueError(f"unknown approaches: {sorted(unknown)}")
    return tuple(a for a in registry if a.approach_id in approach_ids)


def build_store(annotations: DataFrame, encoders, path, images: DataFrame = None, registry=REGISTRY, root="", cache=None):
    """The build job: annotations to clean rows to vectors, stored per approach and type.

    Rebuilt approaches take the place of their old vectors; others stay. With a ``cache`` a rebuild
    encodes what is new. ``images`` is
    ``(content_path, content)``; without it every image is a failed encode.
    """
    clean = corpus.clean(annotations)
    if images is None:
        clean = clean.withColumn("content", F.lit(None).cast("binary"))
    else:
        clean = with_image_bytes(clean, images, root=root)
    store.replace_approach(build(clean, encoders, registry, cache=cache), path, [a.approach_id for a in registry])


def query_vectors(queries: DataFrame, encoders, registry=REGISTRY, query_id="query_id",
                  text="query") -> DataFrame:
    """One row per approach, result type and query, with the vector of the model that
    searches that side. A model encodes each query once, however many sides use it."""
    sides = {}
    for a in registry:
        sides.setdefault(a.text_model, []).append((a.approach_id, "text"))
        sides.setdefault(a.image_model, []).append((a.approach_id, "image"))
    out = None
    for model, used in sides.items():
        encoder = encoders[model]
        rows = F.array(*[
            F.struct(F.lit(a).alias("approach_id"), F.lit(kind).alias("type")) for a, kind in used
        ])
        one = queries.filter(F.col(text) != "").select(
            query_id, text, encoder.text(E.prefixed(text, encoder.query_prefix)).alias("vector")
        ).select(F.inline(rows), query_id, text, "vector")
        out = one if out is None else out.unionByName(one)
    return out
