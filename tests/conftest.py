import os
import sys
from datetime import timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lead_samples import NOW  # noqa: E402
from leadlake.session import build_session  # noqa: E402
from leadlake.sources.tables import LEAD_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Ten made-up leads with gaps, mixed age and mixed completeness.
SAMPLE = [
    ("TechMaré Sistemas", "Ivo Prado", "ivo@maretech.com.br", "(48) 98811-2233", "https://maretech.com.br", "Tecnologia", "São Paulo, SP", "51-200", "Software for tide tables, sold as SaaS", ["saas", "Cartas Náuticas"], 85, 1),
    ("Feira em Casa", "Dora Luz", None, "+55 21 97412-6680", "https://feiraemcasa.com", "E-commerce", "Rio de Janeiro, RJ", "11-50", "Online shop platform 24x7", ["ecommerce"], 78, 20),
    ("HealthTech Labs", None, "lab@health.com", None, None, "Saúde", "São Paulo, SP", "51-200", "Software for telemedicine", None, 92, 60),
    ("Big School", "Ana Costa", "ana@school.org", "(31) 3333-4444", "http://school.org", "Educação", "Belo Horizonte, MG", "1-10", None, ["cursos"], 40, 200),
    ("Bank of Tests", "", "info@bank.com", None, "https://bank.com", "Financeiro", None, "200+", "Payments and software banking", None, 55, 8),
    ("Green Solar", None, None, None, None, None, "Florianópolis, SC", None, "solar energy", None, 70, 31),
    ("LogiTrans 4U", "Pedro", "p@logi.com", "11 98888-8888", "https://logi.com", "Logística", "Campinas, SP", "51-200", "Transport technology with GPS2 tracking", ["gps"], 69, 7),
    ("Software House", "Lia", "lia@gmail.com", None, None, "Tecnologia", "Salvador, BA", "11-50", "The software of the future", None, 88, 91),
    ("the tech machine learning shop", None, None, "123", None, "Tecnologia", "Recife, PE", "1-10", "machine learning for all", None, 10, 2),
    ("Ação & Saúde", "Zé", "ze@acao.com.br", None, "https://www.acao.com.br", "Saúde", "Brasília, DF", "200+", "Clínica médica", ["saúde"], None, 30),
]


@pytest.fixture(scope="session")
def sample_rows():
    rows = []
    for i, (company, contact, email, phone, site, industry, location, size, text, words, score, age) in enumerate(SAMPLE, 1):
        created = NOW - timedelta(days=age)
        rows.append(
            dict(
                id=i, user_id=1 + i % 2, company=company, contact=contact, email=email, phone=phone, website=site, industry=industry,
                location=location, revenue=None, employees=size, description=text, keywords=words, score=score, status="Novo",
                priority="Alta", view_count=0, contact_count=0, conversion_score=0.0, indexed_at=created if i % 4 else None,
                last_contact=None, created_at=created, updated_at=created,
            )
        )
    return rows


@pytest.fixture(scope="session")
def sample(spark, sample_rows):
    return spark.createDataFrame([tuple(r[f.name] for f in LEAD_SCHEMA.fields) for r in sample_rows], LEAD_SCHEMA).cache()
