"""Explicit schemas of the engine's tables; nothing is inferred."""

PARAMETER = "struct<name:string,type_name:string,is_optional:boolean,default_value:string,description:string>"
METHOD = f"struct<name:string,english_name:string,parameters:array<{PARAMETER}>,return_type:string,documentation:string,availability:array<string>,is_function:boolean,is_export:boolean,is_deprecated:boolean,deprecation_info:string>"
PROPERTY = "struct<name:string,english_name:string,type_name:string,is_readonly:boolean,is_indexed:boolean,documentation:string,availability:array<string>>"
EVENT = f"struct<name:string,parameters:array<{PARAMETER}>,documentation:string>"
SECTION = f"struct<name:string,display_name:string,attributes:array<{PROPERTY}>>"

ENTITY = (
    "id string, qualified_name string, display_name string, english_name string, entity_type string, entity_kind string, source struct<tag:string,version:string,path:string>, "
    f"interface struct<methods:map<string,{METHOD}>,properties:map<string,{PROPERTY}>,events:map<string,{EVENT}>>, "
    "constraints struct<parent_types:array<string>,implements:array<string>,string_length:int,number_precision:struct<p:tinyint,s:tinyint>,date_fractions:string,allowed_values:array<string>>, "
    f"relationships struct<owner:string,tabular_sections:array<{SECTION}>,attributes:array<string>,forms:array<string>,commands:array<string>,referenced_by:array<string>,references:array<string>>, "
    "documentation string, availability array<string>, lifecycle struct<introduced_version:string,deprecated_version:string,removed_version:string,replacement:string>, "
    "can_create_with_new boolean, is_global_property boolean, is_global_function boolean, parent_manager string, extended_data string"
)
DIAGNOSTIC = "severity string, location struct<file:string,line:bigint,column:bigint,offset:bigint,length:bigint>, code string, message string, details struct<found:string,expected:string,info:string,suggestion:string>"
RESULT = "list string, code string, level string, message string, file_path string, line bigint, column_no bigint"
