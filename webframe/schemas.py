"""Fixed record schemas as DDL strings."""

PAGES = "page_id bigint, url string, html string"

NODE_FIELDS = {
    "node_id": "int",
    "end_id": "int",
    "parent_id": "int",
    "depth": "int",
    "sib_pos": "int",
    "sib_count": "int",
    "nth_of_type": "int",
    "type_count": "int",
    "n_kids": "int",
    "tag": "string",
    "elem_id": "string",
    "classes": "array<string>",
    "attrs": "map<string,string>",
    "path": "string",
    "anc_ids": "array<int>",
    "own_text": "string",
    "text": "string",
    "text_len": "int",
    "n_links": "int",
    "n_imgs": "int",
    "hidden": "boolean",
    "inner_html": "string",
    "outer_html": "string",
}

CAPTURE = (
    "id string, timestamp double, url string, method string, resource_type string, "
    "request_headers map<string,string>, post_data string, page_url string, frame_url string, "
    "trigger_selector string, status int, mime_type string, response_headers map<string,string>, "
    "body_text string, body_json string, duration_ms double, failed boolean, error string"
)

WS_RECORD = (
    "url string, page_url string, closed boolean, "
    "frames array<struct<direction:string,payload:string,timestamp:double>>"
)

FIELD_SPEC = "struct<name:string,selector:string,attribute:string,transform:array<string>,required:boolean>"
RULE = (
    "mode string, list_rule struct<item_selector:string,fields:array<" + FIELD_SPEC + ">>, "
    "pagination struct<next_selector:string,max_pages:int>, source string, notes string"
)

SAMPLE_FIELD = "struct<name:string,selector:string,attribute:string>"
