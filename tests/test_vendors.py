"""Field mappings: a page of each vendor, and what its postings are."""

import json

import pytest

from feedloom.operators import normalise, vendors

#: vendor -> page, and (external_id, title, location, jd_text, date) of its postings.
PAGES = {
    "amazonjobs": ({"jobs": [{"id_icims": "7", "title": "A", "city": "Pune", "country_code": "IND", "job_path": "/x", "posted_date": "January 5, 2024", "description": "do", "basic_qualifications": "B", "preferred_qualifications": ""}]}, [("7", "A", "Pune, IND", "do\n\nBasic qualifications:\nB", "2024-01-05")]),
    "atlassian": ([{"id": 7, "title": "A", "locations": ["Pune", "Goa"], "overview": "<p>o</p>", "qualifications": "q", "portalJobPost": {"portalUrl": "u", "updatedDate": "2024-01-05"}}], [("7", "A", "Pune; Goa", "o\n\nq", "2024-01-05")]),
    "greythr": ({"data": [{"id": "7", "title": "A", "description": "<p>Location: Pune, India</p>", "created_at": "2024-01-05"}]}, [("7", "A", "Pune", "Location: Pune, India", "2024-01-05")]),
    "gullak": ({"pipelines": [{"id": 7, "name": "A", "description": "d", "experience_required": 3, "status": "active"}, {"id": 8, "name": "B", "status": "closed"}]}, [("7", "A", None, "d\nExperience required: 3", None)]),
    "magicpin": ([{"_id": "g", "jobs": [{"_id": "7", "title": "A", "location": "Pune"}]}, {"_id": "h", "jobs": [{"_id": "8", "title": "B"}]}], [("7", "A", "Pune", "", None), ("8", "B", None, "", None)]),
    "moglix": ({"data": {"rows": [{"id": 7, "job_title": "A", "date_posted": "05-01-2024", "location": "Pune", "jd": "<b>x</b>"}]}}, [("7", "A", "Pune", "x", "2024-01-05")]),
    "nineninegames": ([{"_id": "7", "jobTitle": " A ", "jobLocation": "Pune", "description": "x", "last_modified_on": "2024-01-05"}, {"_id": "8", "jobTitle": "B", "publish": False}], [("7", "A", "Pune", "x", "2024-01-05")]),
    "onecard": ({"data": {"data": [{"id": 7, "attributes": {"title": "A", "location": "Pune", "experience": "3", "description": "d", "publishedAt": "2024-01-05"}}]}}, [("7", "A", "Pune", "Experience required: 3\n\nd", "2024-01-05")]),
    "oracle": ({"items": [{"requisitionList": [{"Id": "7", "Title": "A", "PostedDate": "2024-01-05", "PrimaryLocation": "Pune", "secondaryLocations": [{"Name": "Goa"}, {}]}]}, {}]}, [("7", "A", "Pune; Goa", "", "2024-01-05")]),
    "paramai": ({"data": {"x": {"jobs": [{"id": 7, "title": "A", "locations": [" Pune "], "description": "d", "created_at": "2024-01-05"}]}, "y": {}}}, [("7", "A", "Pune", "d", "2024-01-05")]),
    "peoplehum": ({"responseObject": {"content": [{"id": "7", "title": "A", "descriptionHTML": "<i>x</i>", "isPrivate": False, "location": [{"countryCity": "Pune"}, {}], "requestedDate": 1704412800000}, {"id": "8", "title": "B", "isPrivate": 1}]}}, [("7", "A", "Pune", "x", "2024-01-05")]),
    "pinpoint": ({"data": [{"id": 7, "title": "A", "url": "u", "description": "x", "location": {"city": "Pune", "province": "MH", "name": "n"}}, {"id": 8, "title": "B", "url": "u", "location": {"name": " HQ "}}]}, [("7", "A", "Pune, MH", "x", None), ("8", "B", "HQ", "", None)]),
    "reczee": ({"data": {"requisitions": [{"id": 7, "slug": "a", "title": " ", "designation": "A", "job_description": "x", "locations": [{"city": "Pune", "country": "India"}, {}], "posted_on": "2024-01-05"}, {"id": 8, "slug": "b"}]}}, [("7", "A", "Pune, India", "x", "2024-01-05")]),
    "redbus": ({"Response": {"Data": [{"job_id": "7", "job_title": "A", "location": [], "location_city": ["Pune"], "job_updated_timestamp": "05-01-2024 00:00:00"}]}}, [("7", "A", "Pune", "", "2024-01-05")]),
    "spire2grow": ({"entities": [{"id": 7, "jobTitle": "A", "jobLocation": [{"city": "Pune", "country": "India"}, {"fqLocationName": "Goa"}], "jobDescription": "x", "createdOn": 1704412800000}]}, [("7", "A", "Pune, India; Goa", "x", "2024-01-05")]),
    "talentfunnel": ({"results": [{"vacancyId": "7", "jobTitle": "A", "validFrom": "2024-01-05", "location": {"city": "Pune", "country": "India"}}, {"vacancyId": "8", "jobTitle": "B", "location": None}]}, [("7", "A", "Pune, India", "", "2024-01-05"), ("8", "B", None, "", None)]),
    "urbancompany": ({"jobs": [{"job_id": "7", "job_title": "A", "location": ["Pune", ""], "job_description": "x"}]}, [("7", "A", "Pune", "x", None)]),
    "workable": ({"jobs": [{"title": "A", "shortcode": "7", "city": "Boston", "country": "US", "created_at": "2024-01-05", "description": "x"}, {"title": "A", "shortcode": "7", "locations": [{"city": "Pune", "country": "India"}, {"city": "Boston", "country": "US"}]}]}, [("7", "A", "Boston, US; Pune, India", "x", "2024-01-05")]),
}


@pytest.mark.parametrize("vendor", sorted(PAGES))
def test_pages_of_vendors(spark, vendor):
    page, want = PAGES[vendor]
    raw = spark.createDataFrame([(vendor, "s", 1, json.dumps(page)), (vendor, "t", 1, "{}")], "provider string, slug string, page int, body string")
    got = normalise.normalize_json(raw, vendors.SPECS[vendor]).collect()
    assert sorted(((r["external_id"], r["job_title"], r["location"], r["jd_text"], r["posted_at"] and str(r["posted_at"])[:10]) for r in got), key=str) == want
