"""Which tags of a community object become columns, which mark areas, which are dropped."""

# fixed values: tags that become columns of the line table, in rule order
LINE_TAGS = [
    "access", "access:lanes", "addr:city", "addr:housename", "addr:housenumber", "addr:interpolation",
    "addr:postcode", "addr:street", "aerialway", "barrier", "bicycle", "bicycle:lanes", "bridge", "boundary",
    "construction", "cycleway", "duration", "foot", "highway", "horse", "incline", "junction", "lanes",
    "change:lanes", "turn:lanes", "layer", "maxaxleload", "maxheight", "maxlength", "maxspeed",
    "source:maxspeed", "maxspeed:type", "maxweight", "maxwidth", "motorcar", "motor_vehicle", "name",
    "alt_name", "oneway", "public_transport", "railway", "ref", "restriction", "route", "service", "surface",
    "toll", "tracktype", "traffic_signals", "tunnel", "vehicle", "width", "source:width", "width:lanes",
    "zone:traffic",
]
# fixed values: tags that make a closed way an area, without a column
AREA_TAGS = [
    "abandoned:aeroway", "abandoned:amenity", "abandoned:building", "abandoned:landuse", "abandoned:power",
    "area:highway",
]
# fixed values: tags dropped at import
DELETE_TAGS = [
    "note", "note:*", "source", "source_ref", "attribution", "comment", "created_by", "odbl", "odbl:note",
    "SK53_bulk:load", "tiger:*", "NHD:*", "nhd:*", "gnis:*", "geobase:*", "accuracy:meters", "sub_sea:type",
    "waterway:type", "KSJ2:*", "yh:*", "osak:*", "kms:*", "ngbe:*", "naptan:*", "CLC:*", "3dshapes:ggmodelk",
    "AND_nosr_r", "import", "it:fvg:*",
]
