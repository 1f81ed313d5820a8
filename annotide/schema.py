"""Row types of the canonical tables, as DDL."""

ANNOTATIONS = "image string, obj int, cls int, atts array<int>, coords array<double>, conf double"
IMAGES = "id bigint, file_name string, width int, height int"
CATEGORIES = "id bigint, name string, supercategory string"
PREDICTION_TABLE = "file_name string, object_id int, class_id int, conf double, att_deformation int, att_broken int, att_abandonment int, att_corrosion int"
SEMICOLON_BOXES = "file_name string, x1 int, y1 int, x2 int, y2 int, cat_id int"
VIDEO_TRUTH = "frame int, object int, lt_x double, lt_y double, w double, h double, category int, visible double, extra string"
POSITIONS = "timestamp bigint, latitude double, longitude double, altitude double"
REVIEW = "object_name string, category string, deformation int, broken int, abandonment int, corrosion int"
DEDUP_STATE = "name string, src_name string, height int, width int, img_mean double, aug boolean, swift boolean, rotate boolean, mirror boolean, intersect boolean, color boolean, filter boolean"
ANSWERS = "property string, value int"
CONVERSATION = "struct<id:string,image:string,conversations:array<struct<`from`:string,value:string>>>"
