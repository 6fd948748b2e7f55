"""Source files that nobody wrote by hand in their repository: generated, minified or bundled, vendored, or data saved as source.

A random forest is trained on measures of a file: compression ratio, token entropy, identifier lengths and comment density of its
content where that is stored, the same measures of its path, and its size. Its labels are notices: a header such as "do not edit",
or the marks that generators, bundlers and package managers leave in file and directory names. Notices are hidden from the measures:
header lines are cut off the content, and marked names enter only by their form. A file above the size that the data state for written
files is labelled, too, and its excess is a measure. A file with a notice is found by it; the forest decides on all that carry none.
The forest is fitted on a bounded sample of rows; every row is scored.

Results: paths that are null or of another extension are no cases; repeated and re-scanned rows of a path count once, with their largest
size; null sizes and contents are missing measures; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.session import cut

#: Labelled rows on which the forest is fitted, about so many, chosen by the hash of their key.
SAMPLE_ROWS = 40_000
#: No hand-written file is larger (stated with the data): larger ones are labelled as not written.
LARGEST_WRITTEN = 200_000

#: Share of right verdicts, on held-out labelled rows, that the forest must reach to decide on a file without a notice.
PRECISION = 0.998

# Extensions of source files.
EXTENSIONS = "py js mjs jsx ts tsx go rs java c h cc cpp cs rb php css scss sh".split()

# Directories that hold copies of third-party packages.
VENDOR_DIRS = (
    "vendor vendored _vendor third_party third-party thirdparty 3rdparty site-packages dist-packages external externals extern deps node_modules node_modules_backup "
    "jspm_packages bower_components pods carthage godeps packagecache _vendored"
).split()
# Directories that hold the output of generators.
GENERATED_DIRS = "generated __generated__ autogen gen generated-sources generated-src gen-src codegen-output".split()
# Marks of generators in file names.
GENERATED_NAMES = (
    r"\.pb(?:\.gw)?\.(?:go|cc|cpp|h|c|rs|rb)$|_pb2(?:_grpc)?\.py$|_pb\.(?:js|ts|rb)$|_grpc\.pb\.|\.grpc\.|^zz_generated|[._-](?:generated|autogenerated|autogen|auto)\.\w+$|\.g\.(?:cs|dart|ts)$"
    r"|\.designer\.(?:cs|vb)$|^moc_|^qrc_|^ui_\w+\.autogen|^lex\.[\w.]+\.c$|\.(?:tab|yy)\.[ch]$|^bindata\.go$|_bindata\.go$|_string\.go$|\.gen\.\w+$|_gen\.go$"
)
# Marks of minifiers and bundlers in names of scripts and style sheets.
BUNDLED_NAMES = r"[.-]min\.(?:js|mjs|css)$|\.(?:bundle|pack|chunk)\.(?:js|mjs|css)$|[.-]umd\.(?:js|mjs)$|\.production\.(?:js|mjs)$|[.-][0-9a-f]{8,32}\.(?:js|mjs|css)$|[.-]v?\d+\.\d+\.\d+(?:[.-][a-z]+)*\.(?:js|mjs|css)$"
#: Notices in the first lines of a content.
HEADER = re.compile(r"do not edit|don't edit this file|auto-?generated|automatically generated|code generated|generated (?:by|from|with)|@generated|@license|@preserve|minified by", re.I)
HEADER_LINES = 5

MEASURES = [f"{of}_{m}" for of in ("content", "path") for m in ("ratio", "entropy", "names", "comments")] + ["log_size", "excess", "depth", "digits", "parts", "above_entropy", "above_names", "above_digits"]

_vendor = frozenset(VENDOR_DIRS)
_generated = frozenset(GENERATED_DIRS)
_generated_name = re.compile(GENERATED_NAMES, re.I)
_bundled_name = re.compile(BUNDLED_NAMES, re.I)
_token = re.compile(r"[A-Za-z_]\w*|\d+|[^\w\s]")
_identifier = re.compile(r"[A-Za-z_]\w*")
_comment = re.compile(r"(?m)^\s*(?:#|//|/\*|\*|<!--).*$")


class Forest(NamedTuple):
    """The model, the probability from which on it decides, and its precision and recall alone, on held-out labelled rows."""

    model: PipelineModel
    threshold: float
    precision: float
    recall: float


def has_notice(path: str) -> bool:
    """Whether a name in the path says that the file is generated, bundled or a copy."""
    *dirs, name = path.split("/")
    lowered = [d.lower() for d in dirs]
    if any(d in _vendor or d in _generated or d.endswith(("-codegen-output", "_codegen_output")) for d in lowered):
        return True
    return bool(_generated_name.search(name) or _bundled_name.search(name))


def _measures(text: str, comments: float) -> tuple[float, float, float, float]:
    """Compression ratio, token entropy in bits, mean length of identifiers, comment density."""
    raw = text.encode("utf-8", "replace")
    ratio = len(zlib.compress(raw, 1)) / len(raw)
    counts = Counter(_token.findall(text))
    n = sum(counts.values()) or 1
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    names = _identifier.findall(text)
    return ratio, entropy, (sum(map(len, names)) / len(names) if names else 0.0), comments


def content_measures(df: DataFrame) -> DataFrame:
    """(repo_id, path, header, content_ratio, content_entropy, content_names, content_comments) of df's repo_id, path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            header: list[bool] = []
            rows: list[tuple[float, float, float, float]] = []
            for text in batch.column(2).to_pylist():
                lines = text.split("\n", HEADER_LINES)
                told = bool(HEADER.search("\n".join(lines[:HEADER_LINES])))
                body = lines[HEADER_LINES] if told and len(lines) > HEADER_LINES else text
                header.append(told)
                rows.append(_measures(body, sum(len(c) for c in _comment.findall(body)) / (len(body) or 1)) if body else (1.0, 0.0, 0.0, 0.0))
            columns = [pa.array([r[k] for r in rows], type=pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(header), *columns], names=["repo_id", "path", "header", *MEASURES[:4]])

    kinds = ", ".join(f"{m} double" for m in MEASURES[:4])
    return df.select("repo_id", "path", "content").where("content is not null and content <> ''").mapInArrow(run, f"repo_id string, path string, header boolean, {kinds}")


def _path_measures(df: DataFrame) -> DataFrame:
    """repo_id, path, size, header and the content's measures, with notice and the path's measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(1).to_pylist()
            notice = [has_notice(p) for p in paths]
            rows = []
            for p in paths:
                # a marked name only shows its form: words by their lengths, digits as digits
                *dirs, name = p.split("/")
                stem = name.rsplit(".", 1)[0]
                ratio, entropy, names, _ = _measures(stem, 0.0) if stem else (1.0, 0.0, 0.0, 0.0)
                digits = sum(c.isdigit() for c in stem)
                above = "/".join(dirs)
                _, above_entropy, above_names, _ = _measures(above, 0.0) if above else (1.0, 0.0, 0.0, 0.0)
                above_digits = sum(c.isdigit() for c in above) / (len(above) or 1)
                rows.append((ratio, entropy, names, 0.0, float(len(dirs)), digits / (len(stem) or 1), float(len(re.split(r"[._-]", stem))), above_entropy, above_names, above_digits))
            sizes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.where(np.isnan(sizes), 0.0, sizes)
            log_size = np.log2(sizes + 1.0)
            excess = np.log2(np.maximum(sizes / LARGEST_WRITTEN, 1.0))
            column = lambda k: pa.array([r[k] for r in rows], type=pa.float64())
            content = [pa.array(np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1.0)) for k in range(4, 8)]
            told = [n or bool(h) for n, h in zip(notice, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(told), *content, column(0), column(1), column(2), column(3), pa.array(log_size), pa.array(excess), *(column(k) for k in range(4, 10))],
                names=["repo_id", "path", "size", "notice", *MEASURES],
            )

    kinds = ", ".join(f"{m} double" for m in MEASURES)
    return df.mapInArrow(run, f"repo_id string, path string, size bigint, notice boolean, {kinds}")


def source_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo_id, path, size, header, content measures), a row for each source file, written out: it is counted, sampled and scored."""
    wanted = r"\.(?:" + "|".join(EXTENSIONS) + ")$"
    own = files.where(F.lower("path").rlike(wanted)).groupBy("repo_id", "path").agg(F.max("size_bytes").cast("bigint").alias("size"))
    held = content_measures(contents.where(F.lower("path").rlike(wanted))).dropDuplicates(["repo_id", "path"])
    joined = own.join(held, ["repo_id", "path"], "left")
    return cut(joined.select("repo_id", "path", "size", "header", *MEASURES[:4]))


def fit(sources: DataFrame, rows: int = SAMPLE_ROWS, trees: int = 30, depth: int = 14, seed: int = 7) -> Forest | None:
    """The forest, fitted on three quarters of about `rows` rows, and the probability from which on it is PRECISION sure on the
    last quarter; None if the sample has no two classes. sources is read twice and should be written."""
    share = min(1.0, rows / max(sources.count(), 1))
    sample = sources.where(F.pmod(F.xxhash64("repo_id", "path", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    large = F.coalesce("size", F.lit(0)) > LARGEST_WRITTEN
    labelled = _path_measures(sample).withColumn("label", (F.col("notice") | large).cast("double"))
    held = F.pmod(F.xxhash64("path", "repo_id"), F.lit(4)) == 0
    labelled = labelled.select("label", held.alias("held"), *MEASURES).cache()
    try:
        learned = labelled.where(~F.col("held"))
        if learned.select("label").distinct().count() < 2:
            return None
        assembler = VectorAssembler(inputCols=MEASURES, outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", maxBins=64)
        model = PipelineModel([assembler, forest.fit(assembler.transform(learned))])
        # bounded by the sample's rows
        judged = model.transform(labelled.where("held")).select(vector_to_array("probability")[1].alias("p"), "label").collect()
    finally:
        labelled.unpersist()
    ranked = sorted(((r.p, r.label) for r in judged), reverse=True)
    threshold, right = 1.0, 0.0
    # of the forest alone, where it says yes
    said = [label for p, label in ranked if p > 0.5]
    precision, recall = sum(said) / (len(said) or 1), sum(said) / (sum(label for _, label in ranked) or 1)
    for k, (p, label) in enumerate(ranked, 1):
        right += label
        if right / k >= PRECISION and (k == len(ranked) or ranked[k][0] < p):
            threshold = (p + (ranked[k][0] if k < len(ranked) else 0.0)) / 2
    return Forest(model, max(threshold, 0.5), precision, recall)


def scored(sources: DataFrame, forest: Forest | None) -> DataFrame:
    """(repo_id, path, size, notice, probability, found) of every source file."""
    measured = _path_measures(sources)
    if forest is None:
        told, threshold = measured.withColumn("probability", F.lit(0.0)), 1.0
    else:
        told, threshold = forest.model.transform(measured).withColumn("probability", vector_to_array("probability")[1]), forest.threshold
    found = F.col("notice") | (F.col("probability") > threshold)
    return told.select("repo_id", "path", "size", "notice", "probability", found.alias("found"))
