"""Data contracts for Spark: declare a decoder, run it over a DataFrame, get typed rows and every issue."""

from .functions.catalogue import ENGLISH, JAPANESE, Messages, PropertiesError, interpolate, interpolate_fully, parse_properties
from .operators import encode
from .operators.collections import dict_of, list_of, set_of
from .operators.core import Decoder, lazy, new_decoder, new_decoder_with_path, one_of, unwrapped
from .operators.objects import Fields, discriminate, enum_of, fields, is_given, literal, object_of, optional, presence, presence_of
from .operators.scalars import binary, boolean, decimal_number, float32, float64, int32, int64, integer, parse_uri, string, uint, uint32, uint64
from .plans.api import Result, decode, decode_json
from .plans.issues import error_text, flatten, format_tree, group_by_path, render
from .plans.outcome import Outcome, issue
from .plans.trees import Tree, decode_tree, encode_tree
from .sources.nodes import Json, Missing, Node, Typed
