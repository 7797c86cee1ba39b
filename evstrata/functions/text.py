"""Text forms of the reports: sizes, counts, JSON values, file names, message classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def human_size(size: Column) -> Column:
    """Bytes in steps of 1024 with one decimal beyond plain bytes."""
    out = F.format_string("%d B", size.cast("bigint"))
    for k in range(1, len(UNITS)):
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {UNITS[k]}", size / float(1024**k))).otherwise(out)
    return out


def counted(n: Column, noun: str) -> Column:
    """``1 run``, ``2 runs``."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def json_value(value: Column) -> Column:
    """A metadata value as JSON: lists, objects, quoted texts and decimal numbers stay, all else is quoted and escaped."""
    ready = value.rlike(r'^\s*[\[{]') | value.rlike(r'^".*"$') | value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    # The value as the one field of an object, without what stands around it.
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(ready, value).otherwise(quoted)


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def output_name(pattern: str, number: Column, first: tuple[Column, Column], last: tuple[Column, Column], input_stem: Column | None = None) -> Column:
    """A roll-over name: ``%#`` the number, ``%r %s`` / ``%R %S`` first and last run and sub-run, ``%ifb`` the input's stem."""
    out: Column = F.lit(pattern)
    for mark, value in (("%ifb", input_stem), ("%#", number), ("%r", first[0]), ("%s", first[1]), ("%R", last[0]), ("%S", last[1])):
        if value is not None:
            out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def check_name_pattern(pattern: str, switching: bool, check: bool = True) -> None:
    """With file switching on, a name without a number would be overwritten."""
    if switching and check and "%#" not in pattern:
        raise ValueError(f"output file name {pattern!r} needs '%#' when file switching is on")


@dataclass(frozen=True)
class MessageRule:
    """A message fits if it holds all ``parts`` and none of ``without``, and comes from a place that holds ``place``."""

    action: str
    parts: tuple[str, ...] = ()
    place: str = ""
    without: tuple[str, ...] = ()


SUPPRESS, INFO, ERROR, THROW = "suppress", "info", "error", "throw"
#: Fixed value: severities up to this one are information.
INFO_LEVEL = 1000
# Known messages by class, in the order in which the classes are asked.  What fits none is thrown.
MESSAGE_RULES: tuple[MessageRule, ...] = (
    MessageRule(SUPPRESS, ("no dictionary for class ", "Transient<", "ProductRegistry::Transients> is available")),
    MessageRule(SUPPRESS, ("no dictionary for class ", "DoNotRecordParents is available")),
    MessageRule(INFO, ("already in TClassTable",)),
    MessageRule(INFO, ("matrix not positive definite",)),
    MessageRule(INFO, ("number of iterations was insufficient",)),
    MessageRule(INFO, ("bad integrand behavior",)),
    MessageRule(INFO, ("dictionary",), without=("Error parsing payload code for class",)),
    MessageRule(INFO, place="Fit"),
    MessageRule(INFO, place="TDecompChol::Solve"),
    MessageRule(INFO, place="THistPainter::PaintInit"),
    MessageRule(INFO, place="TGClient::GetFontByName"),
    MessageRule(INFO, place="TUnixSystem::GetHostByName"),
    MessageRule(INFO, ("Ignoring trailing",), "TTree::ReadStream"),
    MessageRule(INFO, ("DISPLAY not set",), "TUnixSystem::SetDisplay"),
    MessageRule(INFO, place="TNetXNGFile::Open", without=("[FATAL]",)),
    MessageRule(ERROR, place="TUnixSystem::DispatchSignals"),
)


def classify(severity: Column, place: Column, message: Column, rules: tuple[MessageRule, ...] = MESSAGE_RULES) -> Column:
    """``suppress``, ``info``, ``error`` or ``throw``, asked in this order; a missing place or message reads ``?``."""
    place, message = F.coalesce(place, F.lit("?")), F.coalesce(message, F.lit("?"))

    def any_of(action: str) -> Column:
        out = F.lit(False)
        for r in rules:
            if r.action == action:
                fits = place.contains(r.place)
                for part in r.parts:
                    fits = fits & message.contains(part)
                for part in r.without:
                    fits = fits & ~message.contains(part)
                out = out | fits
        return out

    return F.when(any_of(SUPPRESS), SUPPRESS).when((severity <= INFO_LEVEL) | any_of(INFO), INFO).when(any_of(ERROR), ERROR).otherwise(THROW)
