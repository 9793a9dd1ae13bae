"""What the database itself provides. Packages are known by pattern, functions by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKAGE = r"^(dbms_\w+|utl_\w+|apex_\w+|owa\w*|ora_\w+|sdo_\w+|ctx_\w+|ords\w*|sys|standard|htp|htf|wpg_docload|xmldom|xmlparser|xslprocessor|xmltype|anydata|anytype|anydataset|diutil|plitblm|ku\$_\w+|sa_\w+|json_\w+)$"
FUNCTIONS = frozenset("""abs acos add_months ascii asin atan atan2 bfilename bin_to_num bitand cast ceil chartorowid chr coalesce
concat convert corr cos cosh count current_date current_timestamp decode deref dump empty_blob empty_clob exp extract floor
from_tz greatest hextoraw initcap instr instrb json_array json_object json_query json_value lag last_day lead least length lengthb listagg ln localtimestamp log
lower lpad ltrim max median min mod months_between nanvl new_time next_day nlssort numtodsinterval numtoyminterval nullif nvl nvl2 power
rank rawtohex regexp_count regexp_instr regexp_like regexp_replace regexp_substr remainder replace round row_number rowidtochar rpad rtrim
sign sin sinh soundex sqrt stddev substr substrb sum sys_context sys_guid sysdate systimestamp tan tanh to_binary_double to_blob to_char to_clob
to_date to_dsinterval to_multi_byte to_nchar to_nclob to_number to_single_byte to_timestamp to_timestamp_tz to_yminterval translate treat trim trunc
tz_offset uid upper user userenv value variance vsize width_bucket xmlagg xmlelement xmlforest avg raise_application_error sqlcode sqlerrm dense_rank first_value last_value ntile
cume_dist percent_rank reverse nls_upper nls_lower sys_extract_utc ora_hash xmltype anydata sys_xmlgen sys_connect_by_path existsnode extractvalue""".split())
METHODS = frozenset("count first last next prior exists delete extend trim limit".split())
#: (category, pattern), the first that matches.
CATEGORIES = [
    ("FILE_IO", r"^(utl_file|dbms_lob_file|dbms_backup\w*)$"), ("NETWORK", r"^(utl_http|utl_smtp|utl_tcp|utl_mail|utl_inaddr|utl_url|utl_dbws|dbms_ldap\w*|apex_web_service|apex_mail)$"),
    ("SCHEDULER", r"^(dbms_job|dbms_scheduler)$"), ("MESSAGING", r"^(dbms_aq\w*|dbms_pipe|dbms_alert)$"), ("LOCKING", r"^dbms_lock$"),
    ("CONSOLE", r"^(dbms_output|dbms_debug)$"), ("SESSION", r"^(dbms_session|dbms_application_info)$"), ("WEB", r"^(htp|htf|wpg_docload|owa\w*|apex_\w+|ords\w*)$"),
    ("DYNAMIC_SQL", r"^dbms_sql$"), ("CRYPTO_RANDOM", r"^(dbms_crypto|dbms_random|dbms_obfuscation_toolkit)$"), ("LOB", r"^(dbms_lob|utl_raw)$"),
    ("XML", r"^(dbms_xml\w*|xmldom|xmlparser|xslprocessor|xmltype|dbms_xslprocessor)$"), ("ADMIN", r"^(dbms_stats|dbms_utility|dbms_metadata|dbms_redefinition|dbms_space|dbms_system|dbms_monitor)$"),
]


def is_package(name: Column) -> Column:
    return F.lower(name).rlike(PACKAGE)


def is_function(name: Column) -> Column:
    return F.lower(name).isin(*sorted(FUNCTIONS))


def is_method(name: Column) -> Column:
    return F.lower(name).isin(*sorted(METHODS))


def category(package: Column) -> Column:
    out = F.lit("OTHER_BUILTIN")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(F.lower(package).rlike(pattern), name).otherwise(out)
    return out
