"""The queries of this subpackage and the SQL that matches them."""

from __future__ import annotations

from .chat_format import OP12_SQL, op12_chat_format
from .decontaminate import op7_decontamination
from .html_extract import op5_html_extract
from .langid import op9_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .line_templates import OP6_SQL, op6_line_templates
from .mixing import OP8_SQL, op8_mixing
from .pareto import OP13_SQL, op13_pareto_layers
from .partenum import OP2_SQL, op2_near_duplicates
from .quality_classifier import op10_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .token_output import op4_token_output
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_output": op4_token_output,
    "op5_html_extract": op5_html_extract,
    "op6_line_templates": op6_line_templates,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_lexical_search": op11_lexical_search,
    "op12_chat_format": op12_chat_format,
    "op13_pareto_layers": op13_pareto_layers,
}

ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op2_near_duplicates": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op6_line_templates": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_pareto_layers": OP13_SQL,
}
