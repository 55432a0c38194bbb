"""Default tables of the engine. All of them are parameters of the functions that use them."""

from __future__ import annotations

# Constants of the ranking.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
GRAPH_SHARE = 0.35
IDENTIFIER_WEIGHT, NAME_WEIGHT, ENTITY_WEIGHT = 0.02, 0.015, 0.005
EDGE_WEIGHTS = {"INHERITS_METHOD": 2.0, "CALLS": 1.5, "IMPORTS": 1.0, "DEFINES": 0.0}
OTHER_EDGE_WEIGHT = 1.0

# Words of a question that carry no meaning.
STOP_WORDS = ("how", "does", "do", "the", "a", "an", "is", "are", "in", "of", "to", "for", "with", "and", "on", "from", "flask")

# Phrases of a question and the terms they add, in order.
EXPANSIONS = (
    ("register url rules", ("add_url_rule", "url_map", "endpoint", "view_func", "route")),
    ("routing", ("add_url_rule", "url_map", "endpoint", "route")),
    ("save sessions", ("save_session", "SessionInterface", "SecureCookieSessionInterface", "session", "cookie")),
    ("user sessions", ("save_session", "SessionInterface", "SecureCookieSessionInterface", "session")),
    ("handle exceptions", ("handle_exception", "handle_user_exception", "errorhandler", "HTTPException")),
    ("process request", ("full_dispatch_request", "dispatch_request", "preprocess_request", "process_response", "request")),
    ("send static file", ("send_static_file", "send_file", "send_from_directory", "static_folder")),
)

# Attributes of known type (class, attribute, class of the attribute).
ATTRIBUTE_TYPES = (("BlueprintSetupState", "app", "App"),)

# Calls that are made later, through a stored function (source, target, sentence).
DEFERRED = (
    ("Blueprint.add_url_rule", "Blueprint.record", "Blueprint.add_url_rule records a deferred function through Blueprint.record()."),
    ("Blueprint.record", "BlueprintSetupState.add_url_rule", "Blueprint.record stores the deferred function that later invokes BlueprintSetupState.add_url_rule()."),
)

# What a piece of source text says about the operation (token, phrase), in order.
OPERATIONS = (
    ("url_map", "updates the application's URL map"),
    ("view_functions", "stores the associated view function"),
    ("dispatch_request", "dispatches the request to the matched endpoint"),
    ("full_dispatch_request", "performs the request dispatch pipeline"),
    ("handle_exception", "handles an exception"),
    ("process_response", "processes the response"),
    ("send_from_directory", "returns a file from the configured directory"),
    ("set_cookie", "sets the response cookie"),
    ("delete_cookie", "removes the response cookie"),
    ("raise", "reraises the exception when no handler is available"),
)

# Behaviour rules (group, calls, texts, assigned, targets, sentence), in order. A rule fires if each
# set of its calls meets the code's calls, all its texts occur, each of its sets of assigned or called names meets
# the code's, and each of its targets is part of an assignment. Of a group with a name the first that fires counts.
_ENDPOINT = ({"assigned": {"endpoint"}, "calls": {"_endpoint_from_view_func"}},)
RULES = (
    ("", ({"self.ensure_sync", "ensure_sync"},), ("view_functions", "endpoint"), (), (), "It dispatches the request to the matched endpoint's view function."),
    ("", (), ("provide_automatic_options", "req.method", '"OPTIONS"', "make_default_options_response"), (), (), "For an OPTIONS request with automatic OPTIONS support enabled, it returns the default OPTIONS response."),
    ("endpoint", (), (), (*_ENDPOINT, {"assigned": {"methods"}}), (), "It determines the endpoint and allowed HTTP methods."),
    ("endpoint", (), (), _ENDPOINT, (), "It determines the endpoint used by the URL rule."),
    ("endpoint", (), (), ({"assigned": {"methods"}},), (), "It determines the allowed HTTP methods."),
    ("", (), ("provide_automatic_options", "required_methods", '"OPTIONS"'), (), (), "It enables automatic OPTIONS support when required."),
    ("url_map", ({"self.url_map.add"},), (), (), (), "It creates a URL rule and adds it to the application's URL map."),
    ("url_map", ({"self.url_rule_class"},), (), (), (), "It creates a URL rule for the endpoint."),
    ("", (), (), (), ("view_functions",), "It associates the endpoint with the view function."),
    ("", (), ("self.record", "s.add_url_rule"), (), (), "For a blueprint, it records the URL-rule registration so the rule can later be applied to the application."),
    ("", ({"self.get_signing_serializer"}, {"response.set_cookie"}), (), (), (), "It serializes the session data and stores it in a signed cookie."),
    ("", ({"response.delete_cookie"},), (), (), (), "It removes the session cookie when the session is empty and modified."),
    ("", ({"self.handle_http_exception"},), (), (), (), "It delegates HTTP exceptions to the HTTP exception handler."),
    ("", ({"self._find_error_handler"},), (), (), (), "It looks up a registered error handler."),
    ("", ({"self.log_exception"},), (), (), (), "It logs the unhandled exception."),
    ("", ({"self.finalize_request"},), (), (), (), "It finalizes the generated response."),
    ("", ({"send_from_directory", "flask.send_from_directory"},), (), (), (), "It serves the requested file from the configured static directory."),
    ("", ({"self.make_response"},), (), (), (), "It converts the result into a response object."),
)
ABSTRACT_SENTENCE = "It defines an abstract contract and raises `NotImplementedError`."

#: Folders that an inspection passes over.
PRUNED = (".git", "__pycache__", ".venv")
