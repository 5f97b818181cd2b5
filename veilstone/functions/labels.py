"""Small classifications of names, hosts, errors, settings and progress, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.governance import SITES

EXTENSIONS = ("txt", "docx", "xlsx", "pdf", "png", "jpg", "jpeg")
LARGEST_BYTES = 50 * 1024 * 1024


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))


def classify_file(name: Column, size: Column) -> Column:
    return F.when(~extension(name).isin(*EXTENSIONS), "unscannable").when(size > LARGEST_BYTES, "toolarge").otherwise("scannable")


def file_key(name: Column, size: Column) -> Column:
    return F.concat_ws("|", name, size.cast("string"))


def size_key(size: Column, time_ms: Column) -> Column:
    return F.concat(F.lit("#"), size.cast("string"), F.lit("|"), time_ms.cast("string"))


def parse_size_key(key: Column) -> Column:
    part = lambda i: F.when(key.rlike(r"^#[0-9]{1,18}\|[0-9]{1,18}$"), F.regexp_extract(key, r"^#([0-9]+)\|([0-9]+)$", i).cast("long"))
    return F.struct(part(1).alias("size"), part(2).alias("time_ms"))


def site_of_host(host: Column) -> Column:
    """The site whose domain the host is, or is below; look-alikes are none."""
    out = F.lit(None).cast("string")
    for domain, site in SITES.items():
        out = F.when((F.lower(host) == domain) | F.lower(host).endswith("." + domain), site).otherwise(out)
    return out


def document_head(head: Column) -> Column:
    return F.hex(F.substring(head, 1, 4)).isin("25504446", "504B0304", "D0CF11E0", "7B5C7274")


def model_failure(message: Column) -> Column:
    """The first of six codes whose words the message has."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low.rlike("abort|cancel"), "cancelled").when(low.rlike("timeout|timed out"), "timeout").when(low.rlike("memory|allocation|oom"), "out_of_memory")
        .when(low.rlike("webgpu|gpu|adapter|device lost"), "gpu").when(low.rlike("fetch|network|load|404"), "model_load").otherwise("unknown")
    )


def stage_of_step(step: Column) -> Column:
    low = F.lower(F.coalesce(step, F.lit("")))
    stage = (
        F.when(low.rlike("block|fail|error"), "decision").when(low.rlike("deliver|replay|upload"), "delivery").when(low.rlike("mask"), "mask")
        .when(low.rlike("ocr|scan|model|detect"), "scan").when(low.rlike("queue|wait"), "queue").otherwise("capture")
    )
    return F.struct(stage.alias("stage"), F.when(low.rlike("fail|error|block"), "failed").when(low.rlike("done|ready|finish|complete"), "done").otherwise("running").alias("status"))


def browser_of_agent(agent: Column) -> Column:
    """Edge is looked for before Chrome, whose name it also carries."""
    version = lambda mark: F.regexp_extract(agent, mark + r"/([0-9]+)", 1)
    browser = F.when(F.contains(agent, F.lit("Edg/")), F.concat(F.lit("Edge "), version("Edg"))).when(F.contains(agent, F.lit("Chrome/")), F.concat(F.lit("Chrome "), version("Chrome"))).otherwise("other")
    system = F.when(F.contains(agent, F.lit("Windows")), "Windows").when(F.contains(agent, F.lit("CrOS")), "ChromeOS").when(F.contains(agent, F.lit("Mac OS")), "macOS").when(F.contains(agent, F.lit("Linux")), "Linux").otherwise("other")
    return F.struct(browser.alias("browser"), system.alias("system"))


def prompt_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def column_number(letters: Column) -> Column:
    """A is 0, Z is 25, AA is 26."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)) - 1


SETTINGS = {"enabled": "true", "model_required": "true", "profile": "balanced", "rules_url": "", "audit_url": ""}
PROFILES = ("fast", "balanced", "thorough")


def settings(stored: Column, policy: Column) -> Column:
    """Defaults, then what is stored, then policy, by known key; booleans cast, slashes at a URL's end cut, a bad profile becomes balanced."""
    fields = []
    for key, default in SETTINGS.items():
        value = F.coalesce(F.element_at(policy, key), F.element_at(stored, key), F.lit(default))
        if default in ("true", "false"):
            value = F.lower(value).isin("true", "1", "yes", "on")
        elif key == "profile":
            value = F.when(value.isin(*PROFILES), value).otherwise("balanced")
        else:
            value = F.regexp_replace(value, "/+$", "")
        fields.append(value.alias(key))
    return F.struct(*fields)


def recommended_profile(cores: Column, memory_gb: Column) -> Column:
    return F.when((cores >= 8) & (memory_gb >= 8), "thorough").when((cores <= 2) | (memory_gb <= 2), "fast").otherwise("balanced")


def masked_name(stem: Column, suffix: str, extension_: Column, fallback: str = "document") -> Column:
    """A safe file name from a masked stem."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(stem, r'[\\/:*?"<>|\x00-\x1F]', "_"), r"\s+", " "))
    return F.concat(F.when(clean == "", fallback).otherwise(clean), F.lit(suffix), F.lit("."), extension_)


def megabytes(size: Column) -> Column:
    return F.concat(F.format_string("%.1f", size / 1048576.0), F.lit(" MB"))


def step_fraction(page: Column, step: Column, pages: Column) -> Column:
    """Progress of a page renderer: four steps a page and a final one; an unknown step is null."""
    place = F.when(step == "render", 1).when(step == "recognise", 2).when(step == "paint", 3).when(step == "encode", 4)
    return F.when(step == "final", F.lit(1.0)).otherwise((page * 4 + place) / (pages * 4 + 1))


def download_fraction(loaded: Column, total: Column, complete: Column) -> Column:
    """Progress of a download over its files; 99 % at most until all are complete."""
    return F.when(complete, F.lit(1.0)).otherwise(F.least(loaded / total, F.lit(0.99)))
