"""Readers on small files and JSON rows."""

import json

import pytest
from pyspark.sql import functions as F

from hearthspark.sources import readers


def test_csv_readers(spark, tmp_path):
    hpi = tmp_path / "hpi.csv"
    hpi.write_text("﻿Date,RegionName,Index\n01/01/2020,A,100\n01/02/2020,A,\n01/03/2020,A,x\n2020-04-01,A,120\n01/01/2020,B,90\n01/01/2020,B,91\n")
    good, bad = readers.house_price_index(spark, str(hpi))
    assert sorted((r["region"], r["month"], r["value"]) for r in good.collect()) == [("A", "2020-01", 100.0), ("A", "2020-04", 120.0)] and bad.count() == 2
    assert [r["region"] for r in readers.index_regions(good).collect()] == ["A"]
    with pytest.raises(ValueError):
        readers.house_price_index(spark, str(hpi), value="none")
    imd = tmp_path / "imd.csv"
    heads = [k + (" (where 1 is most deprived)" if k.endswith("Rank") else "") for k in readers.IMD_COLUMNS]
    imd.write_text(",".join(f'"{h}"' for h in heads) + "\n" + ",".join(["c", "n", "l", "m", *["7"] * 9]) + "\n")
    assert readers.deprivation(spark, str(imd)).first()["income_rank"] == 7
    census = tmp_path / "census.csv"
    census.write_text("code,name,One,Two\nE1,x,\"1,200\",\nE2,y,3,4\n")
    assert sorted((r["code"], r["category"], r["value"]) for r in readers.census(spark, str(census), "TS1").collect()) == [("E1", "One", 1200.0), ("E2", "One", 3.0), ("E2", "Two", 4.0)]
    stops = tmp_path / "stops.csv"
    stops.write_text("ATCOCode,CommonName,Latitude,Longitude,StopType\n1,A,51,0,RLY\n2,B,52,x,ZZZ\n")
    assert [(r["stop_type"], r["lng"]) for r in readers.stops(spark, str(stops)).orderBy("atco_code").collect()] == [("rail_station", 0.0), ("bus_stop", None)]
    net = tmp_path / "net.csv"
    net.write_text("postcode,postcode area,SFBB\nsw1a 1aa,SW,99.5\n,SW,1\npostcode,postcode area,SFBB\nM1 1AE,M,bad\n")
    assert sorted(tuple(r) for r in readers.broadband(spark, str(net), {"SFBB": "sfbb_pct"}).collect()) == [("M11AE", "M", 0.0), ("SW1A1AA", "SW", 99.5)]
    ppd = tmp_path / "ppd.csv"
    ppd.write_text('"{T}","250000","2020-01-05 00:00","M1 1AE","D","N","F","1","","A ST","","T","D","C","A","A"\n')
    assert readers.price_paid(spark, str(ppd)).first()[:3] == ("{T}", 250000, "2020-01-05")


def test_json_readers(spark, tmp_path):
    epc = tmp_path / "epc.json"
    epc.write_text(json.dumps({"lmk-key": "a", "total-floor-area": "80"}) + "\n" + json.dumps({"rows": [{"lmk-key": "b"}, {"lmk-key": "c"}]}) + "\n")
    assert sorted(r["lmk_key"] for r in readers.certificates(spark, str(epc)).collect()) == ["a", "b", "c"]
    rows = lambda *x: spark.createDataFrame([(json.dumps(v),) for v in x], "json string")
    sale = readers.price_paid_items(rows({"transactionId": "t", "pricePaid": 5, "transactionDate": "Wed, 14 Jan 2026", "propertyType": {"prefLabel": [{"_value": "Detached"}]}, "estateType": {"label": ["Freehold"]}, "propertyAddress": {"postcode": "M1 1AE"}})).first()
    assert (sale["price"], sale["transfer_date"], sale["property_type"], sale["tenure"], sale["postcode"]) == (5, "2026-01-14", "Detached", "Freehold", "M1 1AE")
    got = readers.amenities(rows({"id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "pub", "name": "X"}}, {"id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"shop": "y", "amenity": "cafe"}}, {"id": 3, "tags": {"amenity": "pub"}}, {"id": 4, "lat": 1.0, "lon": 1.0, "tags": {}}), {"shop": ("shop", "y"), "pub": ("amenity", "pub"), "cafe": ("amenity", "cafe")}).collect()
    assert [(r["id"], r["category"], r["lat"]) for r in got] == [(1, "pub", 1.0), (2, "shop", 3.0)]
    ring = [[0, 0], [1, 0], [1, 1]]
    got = readers.polygons(rows({"properties": {"NAME": "p"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}, {"properties": {}, "geometry": None})).collect()
    assert sorted(r["name"] for r in got) == ["m", "m", "p"] and got[0]["ring"][1]["x"] == 1.0
    got = readers.planning_features(rows({"attributes": {"REFVAL": "r", "KEYVAL": "k", "DATEMODIFIED": 0, "STATUS": "Unknown"}, "geometry": {"x": 1.0, "y": 2.0}}, {"attributes": {"REFVAL": "r"}}), "c").collect()
    assert len(got) == 1 and got[0]["status"] is None and got[0]["lat"] == 2.0
    got = readers.air_stations(rows({"id": "1", "label": "x PM10", "station": {"geometry": {"coordinates": [51.0, -1.0]}}}, {"id": "2", "label": "y"})).collect()
    assert [(r["lat"], r["pollutant"]) for r in got] == [(51.0, "pm10")]
    good, bad = readers.checked(spark.createDataFrame([(1.0,), (99.0,), (None,)], "lat double"), lat=(-90, 90))
    assert good.count() == 1 and bad.count() == 2
    assert bad.filter(F.array_contains("reasons", "lat")).count() == 2


def test_files_of_a_folder_have_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "areas [1] a%20b"
    folder.mkdir()
    (folder / "m1.csv").write_text("postcode,postcode area,speed\nm1 1aa,M,9\n")
    (folder / "m2.csv").write_text('﻿speed,"postcode area",postcode,extra\n8,M,m2 2bb,"a,b"\nspeed,postcode area,postcode,extra\n')
    (folder / "m3{x}.csv").write_text("\npostcode area,postcode\nM,m3 3cc\n")
    (folder / "m4.csv").write_text("postcode,postcode area,speed\nm4 4dd,M,bad\n,M,1\n")
    (folder / "empty.csv").write_text("")
    (folder / "header.csv").write_text("postcode area,speed,speed,postcode\n")
    (folder / "twice.csv").write_text("postcode area,speed,speed,postcode\nM,1,2,m5 5ee\n")
    path = str(folder).replace("[", "\\[").replace("]", "\\]")
    got = readers.broadband(spark, path, {"speed": "speed", "none": "none"}).collect()
    want = {("M11AA", 9.0), ("M22BB", 8.0), ("M33CC", 0.0), ("M44DD", 0.0), ("M55EE", 1.0)}
    assert {(r["postcode"], r["speed"]) for r in got} == want and len(got) == 6 - 1 and {r["none"] for r in got} == {0.0}
    table = readers.csv(spark, path)
    assert table.columns == ["postcode", "postcode area", "speed", "extra"]
    assert [r["extra"] for r in table.filter("extra is not null").orderBy("extra").collect()] == ["a,b", "extra"]
    assert len(readers.files_by_header(spark, path)) == 4
    with pytest.raises(ValueError):
        readers.broadband(spark, path, {}, postcode="code")


def test_regions_and_years_of_wide_files(spark, tmp_path):
    homes = tmp_path / "homes"
    homes.mkdir()
    (homes / "a.csv").write_text("la_code,la_name,2020,2021\nE1,A,100,\nE2,B,5,x\n")
    (homes / "b.csv").write_text("2022,la_code,la_name,2020\n7,E3,C,6\n")
    got = readers.household_projections(spark, str(homes), "la_code")
    assert sorted((r["la_code"], r["year"], r["households"]) for r in got.collect()) == [("E1", 2020, 100), ("E2", 2020, 5), ("E3", 2020, 6), ("E3", 2022, 7)]
