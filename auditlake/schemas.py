"""Schemas of the relations that the engine reads and makes."""

FILES = "path string, kind string, size bigint"
#: Of many repositories: a row without a path tells why a repository (or a folder of it) couldn't be listed.
REPOSITORIES = "repo_id string, path string, kind string, size bigint, problem string"
CONTENTS = "path string, content string"
MANIFESTS = "path string, status string, data string, error string"
PROJECTS = (
    "id string, root string, ecosystems array<string>, languages array<string>, frameworks array<string>, package_manager string, "
    "package_name string, dependency_names array<string>, manifest_paths array<string>, execution_support string"
)
WORKSPACES = "owner_project_id string, source_path string, pattern string, supported boolean, matched_project_roots array<string>"
CHANGES = "path string, status string, previous_path string"
NODES = "path string, project_id string"
EDGES = "importer_path string, target_path string, kind string, target_exists boolean, missing_target_proof string, line int, col int"
ALIAS_CONFIGS = "path string, directory string, base_path string, aliases array<struct<pattern:string,targets:array<string>>>"
IMPORTS = "path string, kind string, specifier string, line int, col int, ordinal int"
LOCK_ENTRIES = (
    "lock_root string, path string, package_name string, link boolean, resolved_workspace_path string, source_class string, "
    "git_pinned boolean, tarball boolean, integrity string, sections map<string,map<string,string>>"
)
SPAN = "struct<start:int,end:int,priority:int,line:int,col:int,detector_id:string,family:string,assignment_name:string,severity:string,confidence:string>"
STATEMENTS = "stream_id string, path string, ordinal int, start_line int, end_line int, text string"
OPERATION = (
    "struct<kind:string,schema:string,name:string,enabled:boolean,policy:string,command:string,permissive:boolean,roles:array<string>,"
    "using_known:boolean,using_expression:string,check_known:boolean,check_expression:string,privileges:array<string>,reason:string>"
)
EVIDENCE = "struct<path:string,line:int>"
POLICY_STATE = (
    f"struct<name:string,command:string,permissive:boolean,roles:array<string>,using_known:boolean,using_expression:string,"
    f"check_known:boolean,check_expression:string,evidence:{EVIDENCE},roles_evidence:{EVIDENCE},using_evidence:{EVIDENCE},check_evidence:{EVIDENCE}>"
)
GRANT_STATE = f"struct<role:string,privilege:string,evidence:{EVIDENCE}>"
TABLE_STATE = (
    "stream_id string, schema string, name string, declared boolean, dropped boolean, rls_enabled boolean, force_rls boolean, "
    f"policies_complete boolean, grants_complete boolean, policies array<{POLICY_STATE}>, grants array<{GRANT_STATE}>, "
    f"last_evidence {EVIDENCE}, rls_evidence {EVIDENCE}, force_rls_evidence {EVIDENCE}"
)
CATALOG = {
    "tables": "schema string, name string, owner string, rls_enabled boolean, force_rls boolean, is_partitioned boolean, estimated_rows bigint",
    "policies": "schema string, table string, name string, command string, permissive boolean, roles array<string>, using_expression string, check_expression string",
    "relation_privileges": "schema string, table string, grantor string, grantee string, privilege string, grantable boolean",
    "schema_privileges": "schema string, grantor string, grantee string, privilege string, grantable boolean",
    "default_privileges": "schema string, owner string, grantee string, object_type string, privilege string, grantable boolean",
    "roles": "name string, superuser boolean, bypass_rls boolean, inherits boolean",
    "memberships": "role string, member string, inherit_option boolean, set_option boolean",
}
FINDING_EVIDENCE = "struct<type:string,path:string,schema:string,table:string,policy:string,detail:string>"
FINDINGS = (
    "rule_id string, doctor_id string, severity string, confidence string, category string, title string, message string, "
    "path string, line int, col int, "
    f"evidence array<{FINDING_EVIDENCE}>, impact string, remediation_constraints array<string>, remediation string, "
    "verification struct<command:string,expected:string>, fingerprint string"
)
COVERAGE = "module_id string, status string, scope string, files_examined bigint, statements_examined bigint, statements_recognized bigint, limitations array<string>"
RUNS = "doctor_id string, status string, duration_ms bigint, finding_count bigint, error string, skip_reason string"
CHECK_RUNS = "plan_id string, project_id string, label string, executable string, args array<string>, status string, exit_code int, timed_out boolean, duration_ms bigint, output string"
