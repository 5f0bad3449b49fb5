"""Engine tables derived from the given ones, in Spark; ``ctes.py`` derives the same in SQL.

Messages are whole documents with a Spanish opening line, a sender and a link taken from ``pages``;
arrival times and users come from ``events``. Every table grows with its source.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

NOW = datetime(2024, 1, 31)
NOW_SQL = "timestamp '2024-01-31 00:00:00'"
NOW_EPOCH = 1706659200
PEPPER = b"pepper"

LEADS = (
    "",
    "Instala AnyDesk ahora para ayudarte.",
    "CaixaBank: cuenta bloqueada. Verifica tus datos en 24 horas.",
    "BBVA: envíe el código SMS que acaba de recibir.",
    "Correos: su paquete no se pudo entregar, pague la tasa hoy.",
    "Hola mamá, se me ha roto el móvil. Escríbeme por WhatsApp, necesito dinero.",
    "Gran oferta: descuento y sorteo de un premio.",
    "Su cita está confirmada.",
    "Santander: aviso, no compartas tu código con nadie.",
    "Último aviso de la DGT: confirme su c0d1go y su c l a v e.",
    "Llame al 912 345 678 o al +34 612 345 678.",
    "ING: su IBAN ES91 2100 0418 4502 0005 1332 caduca.",
    "Vea https://bit.ly/a?token=abc123 y http://198.51.100.42/login/cuenta/a/b/c/d ya.",
    "Agencia Tributaria: consulte el portal https://agenciatributaria-pago.top/acceso?email=a@b.es",
    "Paga con Bizum desde https://caixabnk.es/pago para CaixaBank.",
    "Importe 25,50 EUR en la tarjeta 4111 1111 1111 1111, DNI 12345678Z.",
    "sаntander c​ódigo 4nyD3sk, visita https://forms.gle/abcdEFGH1234567890xyzq?b=2&a=1",
    "Buenas, Any Desk caduca; entra en https://login.seguro.xk29vq7rtzp4mlws.example.co.uk/a/1234567",
)
SENDERS = ("+34 612 345 678", "BBVA", "CORREOS", "900 123 456", "InfoDGT", "Promo", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows over all cores: costly text work is not tied to the few row groups or joined partitions that
    they come from."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def choose(index, values) -> F.Column:
    ladder = None
    for i, value in enumerate(values):
        test = index == i
        ladder = F.when(test, F.lit(value)) if ladder is None else ladder.when(test, F.lit(value))
    return ladder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the url of page ``doc_id % count(pages)``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    docs = spark.sql(
        "select *, doc_id % (select count(*) from {pages}) as page_id from {docs}",
        pages=pages, docs=table(spark, sf_dir, "documents"))
    return docs.join(pages, "page_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir).select(
        F.col("event_id").alias("doc_id"), F.col("ts").alias("received_at"), "user_id")
    docs = spread(paged_documents(spark, sf_dir).join(seen, "doc_id"), "doc_id")
    return docs.select(
        F.concat(F.lit("m"), "doc_id").alias("message_id"), "doc_id", "lang",
        F.concat_ws(" ", choose(F.col("doc_id") % len(LEADS), LEADS), "text", "url").alias("body"),
        choose(F.col("doc_id") % len(SENDERS), SENDERS).alias("sender"),
        "received_at", F.col("user_id").cast("string").alias("user_reference"))


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line): page hosts as the lines of a host file, some commented out."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    kind = F.col("page_id") % 4
    return table(spark, sf_dir, "pages").select("page_id", "url", (
        F.when(kind == 0, F.concat(F.lit("127.0.0.1 "), host))
        .when(kind == 1, F.concat(F.lit("0.0.0.0\t"), F.upper(host)))
        .when(kind == 2, F.concat(host, F.lit(" 10.0.0.1"))).otherwise(F.concat(F.lit("# "), host))
    ).alias("value"))


#: Host endings that need suffix rules or IDNA: (as written, in ASCII, registrable in ASCII).
FOREIGN = (
    ("bücher.tienda.co.uk", "xn--bcher-kva.tienda.co.uk", "tienda.co.uk"),
    ("мойбанк.рф", "xn--80abxggjd.xn--p1ai", "xn--80abxggjd.xn--p1ai"),
    ("city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp"),
    ("pagos.tienda.kawasaki.jp", "pagos.tienda.kawasaki.jp", "pagos.tienda.kawasaki.jp"),
    ("www.ck", "www.ck", "www.ck"),
    ("cobros.banco.ck", "cobros.banco.ck", "cobros.banco.ck"),
    ("usuario.github.io", "usuario.github.io", "usuario.github.io"),
    ("españa.com.br", "xn--espaa-rta.com.br", "xn--espaa-rta.com.br"),
    ("straße.de", "strasse.de", "strasse.de"),
    ("nadie.sinsufijo", "nadie.sinsufijo", None),  # no such suffix: the whole host stands for itself
    ("xn--bcher-kva.de", "xn--bcher-kva.de", "xn--bcher-kva.de"),
)


def foreign_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, message_id, ending, url): a link for each page, some with user part or port."""
    number = F.col("page_id")
    ending = choose(number % len(FOREIGN), [f[0] for f in FOREIGN])
    url = F.concat(
        F.when(number % 2 == 0, "https://").otherwise("http://"), F.when(number % 3 == 0, "usuario:clave@").otherwise(""),
        F.lit("p"), number, F.lit("."), ending,
        F.when(number % 4 == 0, ":8443").when(number % 4 == 1, ":443").otherwise(""), F.lit("/a/"), number)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), "page_id").alias("message_id"),
                                                ending.alias("ending"), url.alias("url"))


def foreign_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(provider, ending): the endings as two feeds spell them; the second lists every other page's only."""
    listed = foreign_urls(spark, sf_dir).select("ending", "page_id")
    first = listed.select(F.lit("destroylist").alias("provider"), "ending")
    second = listed.where(F.col("page_id") % len(FOREIGN) % 2 == 0).select(
        F.lit("urlhaus_hosts").alias("provider"), F.upper("ending").alias("ending"))
    return first.unionByName(second)


PROVIDERS = ("urlhaus", "openphish", "urlhaus_hosts", "destroylist", "extra_feed")


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indicator per page and kind: its canonical url or its last three host labels; provider by
    page, seen when the event of the same number happened."""
    pages = table(spark, sf_dir, "pages").join(
        events(spark, sf_dir).select(F.col("event_id").alias("page_id"), "ts"), "page_id")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    is_url = F.col("page_id") % 2 == 0
    bare = F.regexp_replace("url", "#.*$", "")
    value = F.when(is_url, bare).otherwise(F.substring_index(host, ".", -3))
    rows = pages.select(
        choose(F.col("page_id") % len(PROVIDERS), PROVIDERS).alias("provider"),
        F.when(is_url, "url").otherwise("domain").alias("indicator_type"),
        value.alias("value_public"), "ts", (F.col("page_id") % 7 == 0).alias("gone"))
    grouped = rows.groupBy("provider", "indicator_type", "value_public").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.bool_and("gone").alias("gone"))
    return grouped.select(
        "provider", F.concat("provider", F.lit("-last")).alias("snapshot_id"), "indicator_type",
        F.sha2("value_public", 256).alias("value_hash"), "value_public",
        F.when(F.col("gone"), "inactive").otherwise("active").alias("status"),
        "first_seen", "last_seen")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sync per provider and hour in which one of its users acted; errors are failed syncs.
    The last sync of a provider lies a provider-specific time before ``NOW``."""
    acts = events(spark, sf_dir).select(
        choose(F.col("user_id") % len(PROVIDERS), PROVIDERS).alias("provider"),
        F.date_trunc("hour", "ts").alias("fetched_at"), (F.col("event_type") != "error").alias("ok"))
    hourly = acts.groupBy("provider", "fetched_at").agg(
        F.bool_or("ok").alias("succeeded"), F.count("*").alias("entry_count"))
    past = hourly.select(
        F.concat_ws("-", "provider", F.unix_timestamp("fetched_at").cast("string"))
        .alias("snapshot_id"), "provider", F.lit("v1").alias("version"), F.lit("").alias("checksum"),
        "entry_count", "fetched_at", "succeeded", F.lit(None).cast("string").alias("error_type"))
    ages = {"urlhaus": 600, "openphish": 90000, "urlhaus_hosts": 1700, "destroylist": 3600,
            "extra_feed": 21600}
    age = F.coalesce(*[
        F.when(F.col("provider") == p, a) for p, a in ages.items()])
    last = hourly.select("provider").distinct().select(
        F.concat("provider", F.lit("-last")).alias("snapshot_id"), "provider",
        F.lit("v2").alias("version"), F.lit("").alias("checksum"),
        F.lit(1).cast("long").alias("entry_count"),
        F.timestamp_seconds(F.lit(NOW_EPOCH) - age).alias("fetched_at"),
        F.lit(True).alias("succeeded"), F.lit(None).cast("string").alias("error_type"))
    return past.where(F.col("fetched_at") < F.lit(NOW) - F.expr("interval 2 days")).unionByName(last)
