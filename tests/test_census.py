from pinfold.operators import census as K

RAW = "row_id long, fips string, state_name string, county_name string, code string, group_name string, congregations string"


def test_raw_rows_of_a_census(spark):
    rows = [
        (1, "1001.0", "Alabama", "Autauga County", "1", "Southern Baptist Convention", "4"), (2, "01001", "New York", "Autauga parish ", "2", "Sikh", "2.0"), (3, "x", "Ohio", "A", "3", "Muslim Estimate", "9"),
        (4, "2001", "Guam", "Census Area", "4", "Bahai", "3"), (5, "2001", "Alaska", "Aleutians City and Borough", "5", "Zen Buddhism", "1"), (6, "1001", "Alabama", "B", "totals", "Sikh", "50"), (7, "1001", "Alabama", "B", "7", None, "50"),
        (8, "1001", "Alabama", "B", "8", "Sikh", "0"), (9, "1001", "Alabama", "B", "9", "Sikh", None), (10, None, None, None, None, "Judaism", "1"),
    ]
    groups = K.census_groups(spark.createDataFrame(rows, RAW))
    got = {r.row_id: (r.fips, r.state, r.county, r.pos, r.n, r.skipped) for r in groups.collect()}
    assert got[1] == ("01001", "AL", "Autauga", 0, 4, False) and got[2] == ("01001", "NY", "Autauga", 5, 2, False)
    assert got[3][0] is None and got[3][5] and got[4][5] and got[10][5]
    assert got[5][2] == "Aleutians" or got[5][2] == "Aleutians City and"
    assert sorted(got) == [1, 2, 3, 4, 5, 10]
    counties = {r.fips: (r.counts, r.state, r.county) for r in K.census_counties(groups).collect()}
    assert counties["01001"] == ([4, 0, 0, 0, 0, 2], "NY", "Autauga") and counties["02001"][0] == [0, 0, 0, 0, 1, 0] and len(counties) == 2
    assert K.census_counties(groups.limit(0)).count() == 0


def test_gaps_in_a_part_of_the_area(spark):
    gaps = spark.createDataFrame([(1, "b", "KY", 37.0, -84.0), (2, "A", "KY", 37.5, -84.5), (3, "c", "KY", 39.0, -84.0), (4, "z", "IN", 37.0, -84.0), (5, "n", "KY", None, None)], "row_id long, name string, state string, lat double, lon double")
    assert [r.row_id for r in K.gaps_in_area(gaps, (37.0, 38.0, -85.0, -84.0)).collect()] == [4, 2, 1]
