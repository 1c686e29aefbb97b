"""The same or nearly the same records across splits, by hashed canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import place, url_decoded
from ..runtime import cut_lineage

# Endings of image files.
IMAGE_TYPES = "png|jpg|jpeg|jpe|bmp|tif|tiff|gif|webp|dcm|dicom"
# Words that copying, converting or deriving a file adds to its name.
DERIVED = (
    "copy|copie|copia|kopie|dup|duplicate|new|final|edited|"
    "bone|soft|enamel|gray|grey|denoised|denoise|enh|enhanced|contrast|flip|flipped|hflip|mirror|mirrored|"
    "crop|cropped|resized|small|thumb|aug|augmented|rot|rotated|v|ver|version"
)
_TAIL = rf"(?:\.(?:{IMAGE_TYPES})|[\s_.\-]+(?:{DERIVED})[\s_\-]?\d*|[\s_\-]*\(\d+\)|~)+\s*$"
#: Letters of a name from which on a typing error may lie in its digits: those of a code. The
#: digits of a shorter name are a running number ('img12'), so they must agree.
FUZZY_FROM = 6


def name_parts(file_name: Column) -> tuple[Column, Column]:
    """(letters, number): the name's canonical text and its running number.

    Escapes, folders, case, file types, separators and added words fall away; the
    number is the last all-digit part without leading zeros, '' if there is none.
    """
    base = F.lower(F.regexp_extract(F.regexp_replace(url_decoded(file_name), r"\\", "/"), r"([^/]*)\s*$", 1))
    base = F.regexp_replace(base, r"^\s*(?:copy of|kopie von|copie de|copia de)\s+", "")
    stem = F.regexp_replace(base, _TAIL, "")
    parts = F.filter(F.split(stem, r"[\s_.\-]+"), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    numbered = F.coalesce(last.rlike(r"^\d+$"), F.lit(False)) & (F.size(parts) > 1)
    number = F.when(numbered, F.regexp_replace(last, r"^0+(?=\d)", "")).otherwise(F.lit(""))
    text = F.array_join(F.when(numbered, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), "")
    return text, number


def one_slip(x: Column, y: Column) -> Column:
    """Equal but for one letter put in, left out, replaced, or two neighbours swapped."""
    swaps = F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1)))
    swapped = F.exists(swaps, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x))) == y)
    return (F.levenshtein(x, y) <= 1) | ((F.length(x) == F.length(y)) & swapped)


def variants(text: Column) -> Column:
    """The text and each text with one letter left out, but no empty one: two texts one
    slip apart share a variant, unless they have no letter in common."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.filter(each, lambda x: x != "")))


def near(x: Column, y: Column) -> Column:
    """Equal or one slip apart; of two short names only in what isn't a digit."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    code = F.greatest(F.length(x), F.length(y)) >= FUZZY_FROM
    return (x == y) | (one_slip(x, y) & (code | (digits(x) == digits(y))))


def split_names(images: DataFrame, files: DataFrame, root: str = "data/") -> DataFrame:
    """id, source_file, split, text, number, width, height of each image with a known
    source file and known size, once each. source_file is compared as a place below root."""
    below = F.regexp_extract(F.concat(F.lit("/"), place(F.col("source_file"))), rf"/({root}.*)$", 1)
    text, number = name_parts(F.col("file_name"))
    named = images.where(F.col("id").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull() & F.col("file_name").isNotNull()).select(
        "id", below.alias("_f"), text.alias("text"), number.alias("number"), "width", "height"
    )
    known = files.select(place(F.col("source_file")).alias("_f"), F.col("source_file"), "split")
    return named.join(known, "_f").where("text <> '' or number <> ''").select("id", "source_file", "split", "text", "number", "width", "height").distinct()


NAME = ["text", "number", "width", "height"]


def classes(names: DataFrame) -> DataFrame:
    """name_id, text, number, width, height, in_train, in_eval: each canonical name once, the
    class of the images that have it. name_id is the name's 64-bit hash."""
    return names.groupBy(*NAME).agg(F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") != "train").alias("in_eval")).withColumn("name_id", F.xxhash64(*NAME))


def links(classed: DataFrame) -> DataFrame:
    """t_name, e_name: the classes, one of training and one of evaluation, whose names are
    equal (then it is the same class) or one slip apart.

    Only names of a number and size that both sides have are taken apart into variants.
    Copies of a name don't multiply candidates, as names are taken once each.
    """
    size = F.xxhash64("number", "width", "height").alias("s")
    both = classed.groupBy(size).agg(F.bool_or("in_train").alias("t"), F.bool_or("in_eval").alias("e")).where("t and e").select("s")
    near_ = classed.withColumn("s", F.xxhash64("number", "width", "height")).join(both, "s", "left_semi")
    keyed = near_.withColumn("variant", F.explode(variants(F.col("text")))).withColumn("h", F.xxhash64("variant", "s"))
    t = keyed.where("in_train").select("h", F.col("name_id").alias("t_name"), *[F.col(c).alias(f"t_{c}") for c in NAME])
    e = keyed.where("in_eval").select("h", F.col("name_id").alias("e_name"), *[F.col(c).alias(f"e_{c}") for c in NAME])
    same = (F.col("t_number") == F.col("e_number")) & (F.col("t_width") == F.col("e_width")) & (F.col("t_height") == F.col("e_height"))
    slips = t.join(e, "h").where(same & (F.col("t_text") != F.col("e_text")) & near(F.col("t_text"), F.col("e_text"))).select("t_name", "e_name").distinct()
    equal = classed.where("in_train and in_eval").select(F.col("name_id").alias("t_name"), F.col("name_id").alias("e_name"))
    return slips.unionByName(equal)


def members(names: DataFrame) -> DataFrame:
    """id, source_file, split, name_id: which class each image belongs to."""
    return names.select("id", "source_file", "split", F.xxhash64(*NAME).alias("name_id")).distinct()


def related(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members) of one pass over the names: overlaps as pairs of classes and the
    classes' images, whose size doesn't grow with the product of the copies."""
    own = cut_lineage(names)  # the names' expressions are long and read by several branches
    return links(classes(own)), members(own)


def overlaps(names: DataFrame) -> DataFrame:
    """t_id, t_file, e_id, e_file, e_split: every training image and evaluation image
    that show the same radiograph, the links' classes written out. Rows with null size
    or name take no part."""
    linked, own = related(names)
    t = own.where("split = 'train'").select(F.col("id").alias("t_id"), F.col("source_file").alias("t_file"), F.col("name_id").alias("t_name"))
    e = own.where("split <> 'train'").select(F.col("id").alias("e_id"), F.col("source_file").alias("e_file"), F.col("split").alias("e_split"), F.col("name_id").alias("e_name"))
    return linked.join(t, "t_name").join(e, "e_name").where("t_id <> e_id").select("t_id", "t_file", "e_id", "e_file", "e_split").distinct()


def leaked(names: DataFrame) -> DataFrame:
    """e_id, e_file, e_split of evaluation images with any training counterpart: one row
    each, whatever the number of copies. An image of both is judged by its other rows only
    if another image has the name."""
    linked, own = related(names)
    t = own.where("split = 'train'").groupBy(F.col("name_id").alias("t_name")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    by_name = linked.join(t, "t_name").groupBy("e_name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    e = own.where("split <> 'train'").select(F.col("id").alias("e_id"), F.col("source_file").alias("e_file"), F.col("split").alias("e_split"), F.col("name_id").alias("e_name"))
    return e.join(by_name, "e_name").where("lo <> e_id or hi <> e_id").select("e_id", "e_file", "e_split").distinct()
