

from vigia import fixed, schemas as S
from vigia.dims import default_aliases, default_brands
from vigia.operators import scoring
from vigia.plans.score import ScoreOptions, score_messages

CASES = {
    "remote": ("Instala AnyDesk para que el técnico pueda ayudarte", None),
    "clone": ("CaixaBank: cuenta bloqueada. Verifica tus datos en 24 horas en "
              "https://caixabank-seguridad.top/acceso", None),
    "calm": ("Su cita está confirmada para el martes", None),
    "homograph": ("Santander: acceda para confirmar sus datos https://sаntander.com/login", None),
    "ip": ("Accede para actualizar tu cuenta en http://198.51.100.42/login/cuenta", None),
    "forward": ("CaixaBank: hemos detectado un cargo. Si no lo reconoces llama al 900123456", "+34 600111222"),
    "pressed": ("CaixaBank: cuenta bloqueada. Llama inmediatamente al 900123456 para resolverlo.",
                "+34 600111222"),
    "warning": ("No compartas tu código con nadie", None),
    "foreign": ("Tu pedido de Correos llega hoy", "BBVA"),
}


def test_messages_end_to_end(spark):
    df = spark.createDataFrame([(k, *v) for k, v in CASES.items()],
                               "message_id string, body string, sender string")
    rows = {r["message_id"]: r for r in score_messages(
        df, options=ScoreOptions(aliases=default_aliases())).collect()}
    hits = {k: {s["check_name"] for s in r["signals"] if s["status"] == "hit"} for k, r in rows.items()}
    assert rows["remote"]["level"] == S.LEVEL_SCAM and "remote_access" in hits["remote"]
    assert rows["clone"]["level"] == S.LEVEL_SCAM and rows["clone"]["score"] == 95
    assert rows["calm"]["level"] == S.LEVEL_UNCERTAIN and rows["calm"]["score"] == 0
    assert any(s["check_name"] == "claimed_entity_domain_mismatch" and s["hard_rule"]
               for s in rows["homograph"]["signals"])
    assert {"raw_ip_hostname", "phishing_url_keywords"} <= hits["ip"]
    assert rows["forward"]["score"] == 65 and rows["forward"]["level"] == S.LEVEL_UNCERTAIN
    assert rows["pressed"]["score"] == 80 and rows["pressed"]["level"] == S.LEVEL_SCAM
    assert rows["warning"]["requested_action"] != S.ACTION_CODE
    assert "cnmc_alias_mismatch" in hits["foreign"]
    for r in rows.values():
        assert 0 <= r["score"] <= 100 and r["level"] in (S.LEVEL_SCAM, S.LEVEL_UNCERTAIN)
        for s in r["signals"]:
            if s["status"] != "hit":
                assert s["weight"] == 0 and not s["hard_rule"] and s["severity"] == "info"


def decide(spark, signals):
    df = spark.createDataFrame([("m", [tuple(s) for s in signals])], f"message_id string, signals array<{S.SIGNAL.simpleString()}>")
    return scoring.decide(df).first()


def row(name, weight=0, status="hit", hard=False, domain=None, severity="warning", summary="x"):
    return (name, None, weight, severity, summary, None, hard, status, "t", "1", domain)


def test_only_hits_score(spark):
    got = decide(spark, [row("provider_failure", 100, "timeout", True)])
    assert got["score"] == 0 and got["level"] == S.LEVEL_UNCERTAIN
    assert all(r["status"] == "not_fired" for r in got["rule_trace"])


def test_family_counts_once(spark):
    assert decide(spark, [row("risky_tld", 35, domain=d) for d in ("a.top", "b.top")])["score"] == 35


def test_shared_platform_suppresses_noise_only(spark):
    got = decide(spark, [row("shared_infrastructure_context", domain="forms.gle", severity="info"),
                         row("high_domain_entropy", 20, domain="forms.gle"), row("requested_action", 55)])
    assert got["score"] == 55
    assert [s["status"] for s in got["signals"]] == ["hit", "suppressed", "hit"]
    assert got["rule_trace"][2]["suppressed_signal_names"] == ["high_domain_entropy"]


def test_families_name_known_checks():
    named = list(fixed.FAMILY_OF_CHECK)
    assert len(named) == len(set(named)) == 34
    assert len(default_brands()) == 46 and len(default_aliases()) == 33


def test_claimed_brand_longest_alias_wins(spark):
    from vigia.operators.extract import extract_facts
    df = spark.createDataFrame([("1", "correos express avisa", None), ("2", "alerta de correos", None)],
                               "message_id string, body string, sender string")
    got = {r[0]: r[1] for r in extract_facts(df).select("message_id", "claimed_entity").collect()}
    assert got == {"1": "Correos Express", "2": "Correos"}
