"""Schemas of the tables that readers give and operators take."""

from __future__ import annotations

PACKAGES = "package_name string, version string, source string, downloads string, language string"
ALERTS = "rule string, output string, output_fields map<string,string>"
GEM = "name string, version string, authors string, downloads long, homepage_uri string, licenses array<string>, dependencies struct<development:array<struct<name:string,requirements:string>>,runtime:array<struct<name:string,requirements:string>>>"
NPM = "name string, time map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>, bin string, main string, browser string, maintainers array<string>, repository struct<type:string,url:string>, description string, homepage string, license string"
PYPI = "info struct<name:string,version:string,author:string,author_email:string,maintainer:string,maintainer_email:string,home_page:string,license:string,summary:string,requires_dist:array<string>,classifiers:array<string>>, releases map<string,array<struct<upload_time:string,filename:string,md5_digest:string,digests:map<string,string>>>>"
PACKAGIST = "package struct<name:string,type:string,description:string,versions:map<string,struct<name:string,version:string,version_normalized:string,time:string,require:map<string,string>,bin:array<string>,authors:array<struct<name:string,email:string>>>>>"
NUGET = "items array<struct<items:array<struct<catalogEntry:struct<id:string,version:string,published:string,authors:string>>>>>"
#: One shape for all registries: what normalizers give.
METADATA = "pkg string, language string, author string, emails array<string>, description string, homepage string, license string, dependencies array<struct<name:string,version:string>>, dev_dependencies array<struct<name:string,version:string>>, releases array<struct<version:string,ts:timestamp>>, has_install boolean, has_main boolean, has_test boolean, has_exercise boolean"
