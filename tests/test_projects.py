import json

from pyspark.sql import functions as F

from tessera.schemas import ENTITY
from tessera.sources import projects


def _entities(spark, rows):
    data = [{"id": i, "qualified_name": q, "display_name": d, "entity_type": t, "constraints": {"parent_types": parents}, "interface": {"methods": {"М": {"name": "М"}}}} for i, q, d, t, parents in rows]
    return spark.createDataFrame([(json.dumps(x),) for x in data], "j string").select(F.from_json("j", ENTITY).alias("e")).select("e.*")


def test_a_project_comes_back_whole(spark, tmp_path):
    platform = [("p1", "Объект (Object)", "Объект (Object)", "Platform", []), ("p2", "Массив (Array)", "Массив (Array)", "Platform", ["Объект (Object)"])]
    config = [("c1", "Справочники.Товары", "Товары", "Configuration", ["Массив (Array)", "Нет"]), ("c2", "Документы.Массив", "Массив (Array)", "Configuration", ["Справочники.Товары"]), ("c3", "Отчеты.О", "О", "Form", [])]
    whole = _entities(spark, platform + config)
    built = projects.build(whole, "Demo", "/conf", "8.3")
    for _ in range(2):  # saved again, it replaces itself
        projects.save(built, str(tmp_path))
    back = projects.load(spark, str(tmp_path), "Demo", "8.3", whole.where("entity_type = 'Platform'"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(back.entities.orderBy("id")) == rows(whole.orderBy("id"))
    assert {tuple(r) for r in back.edges.collect()} == {("p2", "p1"), ("c1", "p2"), ("c2", "c1")} == {tuple(r) for r in built.edges.collect()}
    assert rows(back.names.select("name", "tier", "id")) == rows(built.names.select("name", "tier", "id"))
    assert {(r.name, r.id) for r in back.names.where("tier = 2").collect()} >= {("Массив (Array)", "c2"), ("О", "c3")}
    m = back.manifest.first()
    assert (m.project, m.config_path, m.version, m.entities, m.platform_entities, m.config_entities) == ("Demo", "/conf", "8.3", 5, 2, 3) and m.created_at
    alone = projects.load(spark, str(tmp_path), "Demo", "8.3")
    assert alone.entities.count() == 3 and {tuple(r) for r in alone.edges.collect()} == {("c2", "c1")}
