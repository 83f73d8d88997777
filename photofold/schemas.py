"""Table contracts as Spark DDL."""

LABEL = "struct<text:string,confidence:double>"
BOX = "struct<x:double,y:double,width:double,height:double>"
FACE = f"struct<bounding_box:{BOX},confidence:double>"

ASSETS = (
    "asset_id string, taken_at bigint, width int, height int, file_signature string, "
    "algo_version int, blur_score double, mean_luma double, phash string, labels_json string, "
    "status int, error_message string, updated_at bigint, face_count int"
)
DUP_GROUPS = "group_id string, representative_asset_id string, best_asset_id string, created_at bigint"
DUP_MEMBERS = "group_id string, asset_id string, distance int"
FACE_GROUPS = (
    "face_id string, cluster_id int, first_seen_asset_id string, representative_uri string, "
    "photo_count int, created_at bigint"
)
FACE_INSTANCES = (
    f"instance_id string, face_id string, asset_id string, bounding_box {BOX}, confidence double"
)
META = "key string, value string"
MEDIA_LISTING = (
    "asset_id string, media_type string, creation_time bigint, width int, height int, "
    "uri string, local_uri string, mtime bigint, size bigint"
)
ALBUM_ASSETS = "album_id string, asset_id string"
REVIEW_EVENTS = "seq bigint, asset_id string, media_type string, action string"
ML_ATTEMPTS = "session_id string, seq bigint, failed boolean"

LIBRARY = "library_id"


def library_keys(df) -> list[str]:
    """``["library_id"]`` when the table serves several libraries, else nothing."""
    return [LIBRARY] if LIBRARY in df.columns else []
