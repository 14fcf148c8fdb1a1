"""Weaknesses (CWE) of findings, by rule id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ID_PREFIX

# Rule ids without prefix and hash, and their weakness.
TABLE = """
EXE-eval CWE-95
EXE-exec CWE-95
EXE-compile CWE-95
EXE-__import__ CWE-502
EXE-subprocess-with-shell-true CWE-78
EXE-os-system CWE-78
EXE-os-popen CWE-78
EXE-commands-getoutput CWE-78
EXE-pickle-deserialization CWE-502
EXE-yaml-load-without-safe-loader CWE-502
EXE-marshal-deserialization CWE-502
EXE-shelve-open CWE-502
EXE-os-dup2 CWE-78
EXE-getattr-on-sensitive-module CWE-470
EXE-__builtins__-access CWE-470
EXE-dynamic-function-lookup-via-glo CWE-470
EXE-dangerous-module-imported-under CWE-470
EXE-new-function CWE-95
EXE-synchronous-shell-execution CWE-78
EXE-shell-exec-with-user-input CWE-78
EXE-child-process-exec CWE-78
EXE-vm-code-execution CWE-94
EXE-deserialization CWE-502
EXE-runtime-exec CWE-78
EXE-processbuilder CWE-78
EXE-objectinputstream CWE-502
EXE-xmldecoder CWE-502
EXE-xstream-deserialization CWE-502
EXE-php-eval CWE-95
EXE-php-shell-execution-function CWE-78
EXE-php-unserialize CWE-502
EXE-curl-piped-to-shell CWE-829
EXE-system CWE-78
EXE-exec-family CWE-78
INJ-sql-string-formatting CWE-89
INJ-sql-string-concatenation CWE-89
INJ-sql-f-string CWE-89
INJ-sql-f-string-in-cursor-execute CWE-89
INJ-sql--format CWE-89
INJ-sql-template-literal CWE-89
INJ-sql-concatenation-with-user-inp CWE-89
INJ-ssrf CWE-918
INJ-ssti CWE-94
INJ-mongodb--where-with-user-input CWE-943
INJ-react-dangerouslysetinnerhtml CWE-79
INJ-innerhtml-assignment CWE-79
INJ-document-write CWE-79
INJ-nosql-query-directly-from-reque CWE-943
INJ-xxe CWE-611
INJ-open-redirect CWE-601
INJ-prototype-pollution CWE-1321
INJ-jwt CWE-345
INJ-prompt-injection CWE-77
INJ-xml-tag-injection CWE-77
INJ-data-exfiltration-instruction CWE-200
INJ-credential/file-access-instruct CWE-200
INJ-api-redirect-instruction CWE-200
INJ-api-base-url-override CWE-200
INJ-gets CWE-120
INJ-sprintf CWE-120
INJ-strcpy CWE-120
INJ-strcat CWE-120
INJ-scanf-with-%s CWE-120
INJ-php-dynamic-include/require CWE-98
INJ-string-concatenation-in-logger CWE-117
INJ-github-actions CWE-78
SEC-hardcoded-secret/token CWE-798
SEC-hardcoded-password CWE-798
SEC-sensitive-data-in-sharedprefere CWE-312
SEC-sensitive-data-in-userdefaults CWE-312
SEC-secret-in-dockerfile-arg/env CWE-798
FIL-access-to-sensitive-credential CWE-552
FIL-shutil-rmtree CWE-459
FIL-symlink-points-outside-project CWE-59
FIL-mktemp CWE-377
NET-socket-connect-to-ip-address CWE-918
NET-raw-socket-operation CWE-918
NET-ats-disabled CWE-319
NET-ssl-certificate-validation-disa CWE-295
PER-k8s CWE-250
PER-container-running-as-root-user CWE-250
PER-privileged-container CWE-250
PER-docker-socket-mount CWE-250
PER-chmod-777 CWE-732
PER-setuid-bit CWE-250
OBF-base64-decoding CWE-506
OBF-rot-encoding CWE-506
OBF-string-concat-assembles-dangero CWE-506
OBF-chr-chain CWE-506
OBF-invisible-unicode-char CWE-506
DEP-suspicious-package CWE-829
DEP-phantom-dependency CWE-829
DEP-lockfile-drift CWE-829
MCP-schema-poisoning CWE-77
MCP-mcp-server CWE-77
MCP-cap-exec CWE-78
MCP-cap-raw-net CWE-918
MCP-cap-file-delete CWE-459
MCP-cap-exec-write CWE-732
MCP-cap-file-write CWE-73
MCP-cap-http CWE-918
MCP-cap-env CWE-526
EXE-process-start CWE-78
INJ-sqlcommand-with-string-concat CWE-89
EXE-binaryformatter-deserializatio CWE-502
EXE-javascriptserializer-deseriali CWE-502
EXE-xmlserializer-with-dynamic-typ CWE-502
EXE-dynamic-assembly-loading CWE-470
INJ-regex-with-user-input CWE-1333
EXE-p/invoke CWE-111
EXE-unsafe-block CWE-787
EXE-torch-load---without-weights-on CWE-502
"""
BY_RULE = {f"{ID_PREFIX}-{rule}": cwe for rule, cwe in (line.split() for line in TABLE.strip().split("\n"))}


def weakness(rule_id: Column) -> Column:
    """The weakness of a rule id, with or without its hash; empty if it has none."""
    known = F.create_map(*[F.lit(x) for kv in BY_RULE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, rule_id), F.try_element_at(known, F.regexp_replace(rule_id, "-[0-9a-f]{4}$", "")), F.lit(""))


def with_weakness(findings: DataFrame) -> DataFrame:
    """Findings with cwe: the detector's own, else that of the rule."""
    return findings.withColumn("cwe", F.when(F.col("cwe") != "", F.col("cwe")).otherwise(weakness(F.col("rule_id"))))
