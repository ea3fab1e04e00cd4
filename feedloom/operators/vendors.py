"""Field mappings of JSON boards, one JsonSpec per vendor."""

from __future__ import annotations

from feedloom.operators.normalise import JsonSpec, register

_ID = "cast(item.{} as string)"
_PLACES = "nullif(array_join(filter(array({}), x -> trim(x) <> ''), ', '), '')"
_EACH = "nullif(array_join(filter({}, x -> trim(x) <> ''), '{}'), '')"
_PARTS = "array_join(filter(array({}), x -> trim(x) <> ''), '{}')"


def _spec(schema: str, items: str, external_id: str, title: str, url: str, location: str = "NULL", posted: str = "NULL", jd: str = "''", keep: str | None = None, remote: str | None = None, html: bool = True) -> JsonSpec:
    columns = {"external_id": _ID.format(external_id), "job_title": title, "job_url": url, "location": location, "posted_at": posted, "jd_text": jd} | ({"is_remote": remote} if remote else {})
    return JsonSpec(schema, items, columns, keep, ("jd_text",) if html else ())


# The shape of each vendor's list and where the posting's fields stand in an item.
SPECS = {
    "ainterviews": _spec("jobs array<struct<id:string,title:string,description:string,location:string,posted_date:string,apply_url:string>>", "jobs", "id", "item.title", "item.apply_url", "item.location", "try_to_timestamp(item.posted_date)", "item.description"),
    "ashby": _spec(
        "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,isRemote:boolean,descriptionHtml:string,descriptionPlain:string,publishedAt:string,jobUrl:string,applyUrl:string>>", "jobs",
        "id", "item.title", "coalesce(item.jobUrl, item.applyUrl, '')", "nullif(array_join(filter(concat(array(item.location), transform(coalesce(item.secondaryLocations, array()), x -> x.location)), x -> x <> ''), '; '), '')",
        "try_to_timestamp(item.publishedAt)", "coalesce(item.descriptionPlain, item.descriptionHtml)", remote="coalesce(item.isRemote, false)",
    ),
    "bajajauto": _spec("jobRequisitions array<struct<jobReqId:string,jobTitle:string,jobUrl:string,jobDescription:string,country:string,State:string,location:string,custCity:string,createdDateTime:string>>", "jobRequisitions", "jobReqId", "item.jobTitle", "item.jobUrl", _PLACES.format("coalesce(nullif(item.custCity, ''), item.location), item.State, item.country"), "try_to_timestamp(item.createdDateTime)", "item.jobDescription"),
    "cvviz": _spec("data array<struct<id:string,title:string,description:string,location:struct<city:string,state:string,country:string,remote:boolean>,publication:struct<createdAt:string>>>", "data", "id", "item.title", "NULL", _PLACES.format("item.location.city, item.location.state, item.location.country"), "try_to_timestamp(item.publication.createdAt)", "item.description", remote="coalesce(item.location.remote, false)"),
    "dover": _spec("results array<struct<id:string,title:string,is_published:boolean,is_sample:boolean,locations:array<struct<name:string>>>>", "results", "id", "trim(item.title)", "NULL", "nullif(array_join(transform(item.locations, x -> x.name), '; '), '')", keep="coalesce(item.is_published, true) AND NOT coalesce(item.is_sample, false)"),
    "eightfold": _spec("positions array<struct<id:string,name:string,location:string,locations:array<string>,t_create:bigint,canonicalPositionUrl:string,job_description:string>>", "positions", "id", "item.name", "item.canonicalPositionUrl", "coalesce(item.location, get(item.locations, 0))", "timestamp_seconds(nullif(item.t_create, 0))", "item.job_description"),
    "greenhouse": _spec("jobs array<struct<id:bigint,title:string,updated_at:string,absolute_url:string,location:struct<name:string>,content:string>>", "jobs", "id", "item.title", "item.absolute_url", "item.location.name", "try_to_timestamp(item.updated_at)", "item.content"),
    "jibe": _spec(
        "jobs array<struct<data:struct<slug:string,title:string,description:string,full_location:string,short_location:string,location_name:string,country:string,location_type:string,posted_date:string,meta_data:struct<canonical_url:string>>>>", "jobs",
        "data.slug", "item.data.title", "item.data.meta_data.canonical_url", "coalesce(item.data.full_location, item.data.short_location, item.data.location_name, item.data.country)", "try_to_timestamp(item.data.posted_date)", "item.data.description",
    ),
    "juspay": _spec("allJobs array<struct<job_id:string,job_title:string,job_location:string,job_description_career:string,job_description_template:string>>", "allJobs", "job_id", "item.job_title", "NULL", "nullif(trim(item.job_location), '')", "NULL", "trim(coalesce(item.job_description_career, item.job_description_template, ''))", html=False),
    "keka": _spec("array<struct<id:string,title:string,description:string,jobLocations:array<struct<city:string,state:string,countryName:string>>,publishedOn:string>>", "", "id", "item.title", "NULL", "nullif(array_join(transform(item.jobLocations, x -> array_join(filter(array(x.city, x.state, x.countryName), y -> y <> ''), ', ')), '; '), '')", "try_to_timestamp(item.publishedOn)", "item.description"),
    "kula": _spec("data array<struct<id:string,title:string,listed:boolean,ats_job:struct<job_description:string,workplace:string,offices:array<struct<city:string,state:string,country:string,location:string,remote:boolean>>>>>", "data", "id", "item.title", "NULL", "nullif(array_join(filter(transform(item.ats_job.offices, o -> coalesce(o.location, array_join(filter(array(o.city, o.state, o.country), y -> y <> ''), ', '))), x -> x <> ''), '; '), '')", "NULL", "item.ats_job.job_description", keep="coalesce(item.listed, true)", remote="coalesce(item.ats_job.workplace = 'remote', false) OR exists(coalesce(item.ats_job.offices, array()), o -> coalesce(o.remote, false))"),
    "leapscholar": _spec("Jobs array<struct<JobId:string,JobTitle:string,JobDescription:string,Location:string,ApplyUrl:string,PublishedDate:string,CreatedDate:string>>", "Jobs", "JobId", "item.JobTitle", "item.ApplyUrl", "nullif(array_join(transform(from_json(item.Location, 'array<struct<Address:string>>'), x -> x.Address), '; '), '')", "try_to_timestamp(coalesce(item.PublishedDate, item.CreatedDate))", "item.JobDescription"),
    "lever": _spec(
        "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,description:string,lists:array<struct<text:string,content:string>>,additionalPlain:string,additional:string,categories:struct<location:string>,workplaceType:string>>", "",
        "id", "item.text", "item.hostedUrl", "item.categories.location", "timestamp_millis(nullif(item.createdAt, 0))",
        "array_join(filter(concat(array(coalesce(item.descriptionPlain, item.description)), transform(coalesce(item.lists, array()), x -> concat_ws('\n', x.text, x.content)), array(coalesce(item.additionalPlain, item.additional))), x -> trim(x) <> ''), '\n\n')",
        remote="coalesce(item.workplaceType = 'remote', false) OR coalesce(item.categories.location rlike '(?i)\\\\bremote\\\\b', false)",
    ),
    "lohum": _spec("array<struct<id:string,designation:string,location:string,jobdescription:string>>", "", "id", "item.designation", "NULL", "nullif(trim(item.location), '')", "NULL", "item.jobdescription"),
    "mynexthire": _spec("reqDetailsBOList array<struct<reqId:bigint,statusId:bigint,reqTitle:string,location:string,locationAddress:string,jdDisplay:string,approvedOn:string>>", "reqDetailsBOList", "reqId", "item.reqTitle", "NULL", "coalesce(item.location, item.locationAddress)", "try_to_timestamp(item.approvedOn)", "item.jdDisplay", keep="item.statusId = 3"),
    "recruitee": _spec("offers array<struct<id:bigint,title:string,status:string,description:string,requirements:string,location:string,remote:boolean,careers_url:string,published_at:string,created_at:string>>", "offers", "id", "item.title", "item.careers_url", "item.location", "try_to_timestamp(coalesce(item.published_at, item.created_at))", "concat_ws('\n\n', item.description, item.requirements)", keep="item.status = 'published'", remote="coalesce(item.remote, false) OR coalesce(item.location rlike '(?i)\\\\bremote\\\\b', false)"),
    "talent500": _spec("jobs array<struct<id:string,title:string,is_job_displayable:boolean,is_active:boolean,status:string,location:string,description:string>>", "jobs", "id", "item.title", "NULL", "item.location", "NULL", "item.description", keep="coalesce(item.is_job_displayable, true) AND coalesce(item.is_active, true) AND coalesce(item.status, '') <> 'closed'"),
    "zohorecruit": _spec("jobs array<struct<id:string,Posting_Title:string,Publish:boolean,City:string,State:string,Country:string,Job_Description:string,Date_Opened:string>>", "jobs", "id", "item.Posting_Title", "NULL", _PLACES.format("item.City, item.State, item.Country"), "try_to_timestamp(item.Date_Opened)", "item.Job_Description", keep="coalesce(item.Publish, true)"),
    "amazonjobs": _spec(
        "jobs array<struct<id_icims:string,title:string,location:string,city:string,country_code:string,job_path:string,posted_date:string,description:string,description_short:string,basic_qualifications:string,preferred_qualifications:string>>", "jobs",
        "id_icims", "item.title", "concat('https://www.amazon.jobs', item.job_path)", "coalesce(item.location, " + _PLACES.format("item.city, item.country_code") + ")", "coalesce(try_to_timestamp(item.posted_date), try_to_timestamp(item.posted_date, 'MMMM d, yyyy'))",
        _PARTS.format("coalesce(item.description, item.description_short), concat('Basic qualifications:<br>', nullif(trim(item.basic_qualifications), '')), concat('Preferred qualifications:<br>', nullif(trim(item.preferred_qualifications), ''))", "<br><br>"),
    ),
    "atlassian": _spec("array<struct<id:string,title:string,locations:array<string>,overview:string,responsibilities:string,qualifications:string,applyUrl:string,portalJobPost:struct<portalUrl:string,updatedDate:string>>>", "", "id", "item.title", "coalesce(item.portalJobPost.portalUrl, item.applyUrl)", _EACH.format("item.locations", "; "), "try_to_timestamp(item.portalJobPost.updatedDate)", _PARTS.format("item.overview, item.responsibilities, item.qualifications", "\n")),
    "greythr": _spec("data array<struct<id:string,title:string,slug:string,description:string,apply_url:string,is_remote:boolean,created_at:string>>", "data", "id", "item.title", "CASE WHEN item.apply_url rlike '(?i)^https?://' THEN item.apply_url END", "nullif(trim(regexp_extract(regexp_replace(item.description, '<[^>]*>', '\n'), '(?i)\\\\blocation\\\\s*:\\\\s*([^\\\\n<,;|]{2,60})', 1)), '')", "try_to_timestamp(item.created_at)", "item.description", remote="coalesce(item.is_remote, false)"),
    "gullak": _spec("pipelines array<struct<id:string,name:string,description:string,experience_required:string,status:string>>", "pipelines", "id", "item.name", "NULL", "NULL", "NULL", _PARTS.format("item.description, concat('Experience required: ', nullif(item.experience_required, ''))", "\n"), keep="coalesce(nullif(item.status, ''), 'active') = 'active'", html=False),
    "magicpin": _spec("array<struct<_id:string,jobs:array<struct<_id:string,title:string,location:string>>>>", "flatten(transform(body, g -> g.jobs))", "_id", "item.title", "NULL", "item.location"),
    "moglix": _spec("data struct<rows:array<struct<id:string,job_title:string,date_posted:string,location:string,jd:string>>>", "data.rows", "id", "item.job_title", "NULL", "item.location", "try_to_timestamp(item.date_posted, 'dd-MM-yyyy')", "item.jd"),
    "nineninegames": _spec("array<struct<_id:string,jobTitle:string,jobLocation:string,description:string,publish:boolean,last_modified_on:string>>", "", "_id", "trim(item.jobTitle)", "NULL", "item.jobLocation", "try_to_timestamp(item.last_modified_on)", "item.description", keep="coalesce(item.publish, true)"),
    "onecard": _spec("data struct<data:array<struct<id:string,attributes:struct<title:string,location:string,experience:string,description:string,publishedAt:string>>>>", "data.data", "id", "item.attributes.title", "NULL", "item.attributes.location", "try_to_timestamp(item.attributes.publishedAt)", _PARTS.format("concat('Experience required: ', nullif(item.attributes.experience, '')), item.attributes.description", "\n\n"), html=False),
    "oracle": _spec("items array<struct<requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string,secondaryLocations:array<struct<Name:string>>>>>>", "flatten(transform(body.items, x -> coalesce(x.requisitionList, array())))", "Id", "item.Title", "NULL", _EACH.format("concat(array(item.PrimaryLocation), transform(coalesce(item.secondaryLocations, array()), y -> y.Name))", "; "), "try_to_timestamp(item.PostedDate)"),
    "paramai": _spec("data map<string,struct<jobs:array<struct<id:string,title:string,slug:string,locations:array<string>,description:string,created_at:string>>>>", "flatten(transform(map_values(body.data), d -> coalesce(d.jobs, array())))", "id", "item.title", "NULL", _EACH.format("transform(item.locations, y -> trim(y))", "; "), "try_to_timestamp(item.created_at)", "item.description"),
    "peoplehum": _spec("responseObject struct<content:array<struct<id:string,title:string,description:string,descriptionHTML:string,isPrivate:string,location:array<struct<countryCity:string>>,requestedDate:bigint>>>", "responseObject.content", "id", "item.title", "NULL", _EACH.format("transform(item.location, y -> y.countryCity)", "; "), "timestamp_millis(item.requestedDate)", "coalesce(nullif(item.descriptionHTML, ''), item.description)", keep="NOT coalesce(lower(item.isPrivate) NOT IN ('false', '0'), false)"),
    "pinpoint": _spec("data array<struct<id:string,title:string,description:string,url:string,workplace_type:string,location:struct<city:string,name:string,province:string>>>", "data", "id", "item.title", "item.url", "coalesce(" + _PLACES.format("item.location.city, item.location.province") + ", nullif(trim(item.location.name), ''))", "NULL", "item.description", remote="coalesce(lower(item.workplace_type) = 'remote', false) OR coalesce(concat_ws(' ', item.location.city, item.location.province, item.location.name) rlike '(?i)\\\\bremote\\\\b', false)"),
    "reczee": _spec("data struct<requisitions:array<struct<id:string,slug:string,title:string,designation:string,job_description:string,locations:array<struct<city:string,country:string>>,posted_on:string>>>", "data.requisitions", "id", "coalesce(nullif(trim(item.title), ''), nullif(trim(item.designation), ''))", "NULL", _EACH.format("transform(item.locations, y -> concat_ws(', ', nullif(trim(y.city), ''), nullif(trim(y.country), '')))", "; "), "try_to_timestamp(item.posted_on)", "item.job_description", keep="coalesce(nullif(trim(item.title), ''), nullif(trim(item.designation), '')) IS NOT NULL"),
    "redbus": _spec("Response struct<Data:array<struct<job_id:string,job_title:string,location:array<string>,location_city:array<string>,location_country:string,is_remote:int,job_updated_timestamp:string,job_created_timestamp:string>>>", "Response.Data", "job_id", "item.job_title", "NULL", "coalesce(get(item.location, 0), get(item.location_city, 0), item.location_country)", "try_to_timestamp(coalesce(item.job_updated_timestamp, item.job_created_timestamp), 'dd-MM-yyyy HH:mm:ss')", remote="coalesce(item.is_remote = 1, false)"),
    "spire2grow": _spec("entities array<struct<id:string,displayId:string,jobTitle:string,jobLocation:array<struct<city:string,state:string,country:string,fqLocationName:string>>,jobDescription:string,createdOn:string>>", "entities", "id", "item.jobTitle", "NULL", _EACH.format("transform(item.jobLocation, y -> coalesce(y.fqLocationName, concat_ws(', ', nullif(y.city, ''), nullif(y.state, ''), nullif(y.country, ''))))", "; "), "coalesce(try_to_timestamp(item.createdOn), timestamp_millis(try_cast(item.createdOn as bigint)))", "item.jobDescription"),
    "talentfunnel": _spec("results array<struct<vacancyId:string,jobTitle:string,applicationUrl:string,validFrom:string,location:struct<formattedAddress:string,city:string,country:string>>>", "results", "vacancyId", "item.jobTitle", "item.applicationUrl", "coalesce(nullif(item.location.formattedAddress, ''), " + _PLACES.format("item.location.city, item.location.country") + ")", "try_to_timestamp(item.validFrom)"),
    "urbancompany": _spec("jobs array<struct<job_id:string,job_title:string,location:array<string>,job_description:string,apply_url:string>>", "jobs", "job_id", "item.job_title", "nullif(item.apply_url, '')", _EACH.format("item.location", "; "), "NULL", "item.job_description"),
    "workable": _spec(
        # The places of one code's rows are one posting's.
        "jobs array<struct<title:string,shortcode:string,url:string,shortlink:string,telecommuting:boolean,published_on:string,created_at:string,country:string,city:string,state:string,locations:array<struct<country:string,city:string,region:string>>,description:string>>",
        "transform(body.jobs, j -> named_struct('job', j, 'places', array_distinct(flatten(transform(filter(body.jobs, k -> k.shortcode = j.shortcode), k -> transform(coalesce(k.locations, array(named_struct('country', k.country, 'city', k.city, 'region', k.state))), y -> concat_ws(', ', nullif(trim(y.city), ''), nullif(trim(y.region), ''), nullif(trim(y.country), ''))))))))",
        "job.shortcode", "item.job.title", "coalesce(item.job.url, item.job.shortlink)", _EACH.format("item.places", "; "), "try_to_timestamp(coalesce(item.job.published_on, item.job.created_at))", "item.job.description", remote="coalesce(item.job.telecommuting, false)",
    ),
}

#: What each vendor's list is filtered by.
KEEP = {provider: spec.keep for provider, spec in SPECS.items() if spec.keep}


def register_vendors() -> None:
    """All vendors into the registry of normalisers."""
    for provider, spec in SPECS.items():
        register(provider, spec)


register_vendors()
