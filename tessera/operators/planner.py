"""Launch planning: offload and context from free memory, as arithmetic over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import DEFAULT_KV_MIB, KV_MIB
from ..functions.text import lookup

# Fixed values of planning.
LEAST_CONTEXT, FLASH_FROM, HEADROOM = 2048, 8192, 1024


def kv_mib_per_token(kind: Column) -> Column:
    return lookup(kind, KV_MIB, DEFAULT_KV_MIB)


def measured_factor(base_mib: Column, layers_on: Column, file_mib: Column, layers: Column) -> Column:
    """Measured over predicted footprint, where it lies in 0.6 to 1.2."""
    share = F.when(layers_on < 0, 1.0).otherwise(F.least(layers_on / F.greatest(layers, F.lit(1)), F.lit(1.0)))
    predicted = file_mib * share
    factor = F.try_divide(base_mib.cast("double"), predicted)
    return F.when((file_mib > 0) & (base_mib > 0) & (predicted >= 1) & factor.between(0.6, 1.2), factor)


def footprint(file_mib: Column, layers_on: Column, layers: Column) -> Column:
    """struct<weight, kv_scale> of the part of a model that is offloaded."""
    share = F.least(layers_on, layers) / layers
    part = F.struct((file_mib * share).cast("long").alias("weight"), F.greatest(share, 1 / layers).alias("kv_scale"))
    whole = F.struct(file_mib.cast("long").alias("weight"), F.lit(1.0).alias("kv_scale"))
    return F.when((layers_on < 0) | layers.isNull() | (layers <= 0), whole).otherwise(part)


def plan_launch(models: DataFrame, cache_type: str = "q8_0", hard_max: int = 524288, headroom: int = HEADROOM, default_context: int = 32768) -> DataFrame:
    """model_id, ngl, ctx, flash_attn, cache_type from model_id, file_mib, layers (null: unknown), free_mib (null: no GPU),
    requested_ngl (-1: all), max_ctx (0: undeclared), and, where given, embed_mib, kv_factor, weight_factor.

    Every layer count from the ceiling down is a row; the largest whose window reaches FLASH_FROM wins, else the
    ceiling itself.  The winner is found by a hash aggregation, so that a task holds and sends one row a model.
    """
    for name, value in (("embed_mib", 0), ("kv_factor", 1.0), ("weight_factor", 1.0)):
        if name not in models.columns:
            models = models.withColumn(name, F.lit(value))
    m = models.withColumns(
        {
            "top": F.when(F.col("max_ctx") > 0, F.least("max_ctx", F.lit(hard_max))).otherwise(F.lit(hard_max)),
            "size": (F.col("file_mib") * F.col("weight_factor")).cast("long"),
            "least_kv": F.ceil(F.lit(KV_MIB["f16"]) * F.col("kv_factor") * LEAST_CONTEXT),
        }
    ).withColumn("room", F.col("free_mib") - headroom - F.col("embed_mib") - F.col("least_kv"))
    known = F.col("layers").isNotNull() & (F.col("layers") > 0) & (F.col("size") > 0)
    want = F.when(F.col("requested_ngl") < 0, F.col("layers")).otherwise(F.least("requested_ngl", "layers"))
    fits = F.floor(F.greatest("room", F.lit(0)) / F.greatest(F.col("size") / F.col("layers"), F.lit(1e-6)))
    m = m.withColumn("most", F.when(known, F.least(want, F.greatest(F.lit(0), F.least(fits, "layers")))).cast("int"))
    whole = F.when(F.col("size") <= F.col("room"), F.col("requested_ngl")).otherwise(0)
    tries = F.when(F.col("free_mib").isNull(), F.array(F.col("requested_ngl").cast("int"))).when(~known, F.array(whole.cast("int"))).when(F.col("most") <= 1, F.array("most")).otherwise(F.sequence("most", F.lit(1), F.lit(-1)))
    rows = m.withColumn("off", F.explode(tries))
    share = F.least(F.col("off") / F.col("layers"), F.lit(1.0))
    weight = F.when(known, (F.col("size") * share).cast("long")).when(F.col("off") < 0, F.col("size")).otherwise(F.when(F.col("layers") > 0, (F.col("file_mib") * share * F.col("weight_factor")).cast("long")).otherwise(F.col("size")))
    scale = F.when(known, F.greatest(share, 1 / F.col("layers"))).otherwise(1.0)
    rows = rows.withColumns({"left": F.col("free_mib") - weight - headroom - F.col("embed_mib"), "scale": scale})

    def fit(rate: float) -> Column:
        per = F.greatest(F.lit(rate) * F.col("scale") * F.col("kv_factor"), F.lit(1e-6))
        return F.least(F.greatest(F.floor(F.floor(F.col("left") / per) / 1024) * 1024, F.lit(LEAST_CONTEXT)), F.col("top"))

    light, heavy = fit(KV_MIB.get(cache_type, DEFAULT_KV_MIB)), fit(KV_MIB["f16"])
    idle = F.greatest(F.least(F.lit(default_context), "top"), F.lit(LEAST_CONTEXT))
    ctx = F.when(F.col("free_mib").isNull(), idle).when(F.col("left") <= 0, LEAST_CONTEXT).when(light >= FLASH_FROM, light).otherwise(heavy).cast("long")
    flash = F.when(F.col("free_mib").isNull(), idle >= FLASH_FROM).otherwise((F.col("left") > 0) & (light >= FLASH_FROM))
    rows = rows.withColumns({"ctx": ctx, "flash_attn": flash})
    good = (F.col("ctx") >= F.least(F.lit(FLASH_FROM), "top")).cast("long")
    place = F.coalesce(good, F.lit(-1)) * F.lit(1 << 33) + F.coalesce("off", F.lit(-(1 << 31)))  # good ones first, then by layers
    ngl = F.when(known & (F.col("requested_ngl") < 0) & (F.col("off") == F.col("layers")) & F.col("free_mib").isNotNull(), -1).otherwise(F.col("off"))
    rows = rows.select("model_id", ngl.cast("int").alias("ngl"), "ctx", "flash_attn", place.alias("_place"))
    best = rows.groupBy("model_id").agg(*(F.max_by(c, "_place").alias(c) for c in ("ngl", "ctx", "flash_attn")))
    return best.select("model_id", "ngl", "ctx", "flash_attn", F.when(F.col("flash_attn"), F.lit(cache_type)).otherwise("").alias("cache_type"))
