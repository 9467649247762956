"""What kind of device an asset is, and which lines may end at it.

All tests read the words of an asset's type, category and name (column ``t``, a
token text), its name's words (``nm``) and its stored type; they are SQL texts, so
a plan asks as many of them as it likes in one projection. ``like`` names the
function that matches a pattern.
"""

from __future__ import annotations

#: Words that tell the kind of a device.
POLES, BOXES, OTBS = "(^| )(tiang|pole|pylon)( |$)", "junction|(^| )jb( |$)", "(^| )(otb|optical termination box)( |$)"
RACKS, RACK_NAMES = "server.?rack|rack.?server", "^(rs|cr)( |$)|^svr office( |$)"
CAMERAS, POWER = "camera|cctv|kamera", "pln|power source|power panel"
INLINE = "junction|(^| )jb( |$)|switch|router|otb|splitter|coupler|core|patch|rack"
EXTENDED = "(^| )extended( |$)"
NUMBERED_BOX = "(^|[^a-z0-9_])jb[-_ ]*[0-9]+ *[.] *[0-9]+([ _-]|$)"
POWER_LINES = "(^| )(power|pln|listrik|feeder)( |$)"
#: Words of infrastructure at which a line of a family may end.
ENDS_OF = {
    "cctv": "junction|(^| )jb( |$)|switch|nvr|server|router|camera|cctv",
    "fiber_optic": "otb|junction|(^| )jb( |$)|switch|router|core|fiber|(^| )fo( |$)",
    "lan": "switch|router|access point|(^| )ap( |$)|printer|server|device|lan",
    "infrastructure": "switch|router|server|junction|(^| )jb( |$)|otb|core|patch|rack|pln|power",
}
LAN_AT_CCTV, FIBER_AT_CCTV = "camera|cctv|junction|(^| )jb( |$)|nvr", "junction|(^| )jb( |$)|otb|fiber|switch"


def kinds(like: str) -> dict[str, str]:
    """Name -> SQL of each test."""
    m = lambda c, p: f"{like}({c}, '{p}')"
    pole = f"(asset_type = 'pole' or {m('t', POLES)})"
    otb = f"(asset_type = 'otb' or {m('t', OTBS)})"
    rack = f"(asset_type in ('rack', 'server_rack') or {m('t', RACKS)} or {m('nm', RACK_NAMES)})"
    box = f"(not {otb} and not {rack} and (asset_type = 'junction_box' or {m('t', BOXES)}))"
    return {
        "is_pole": pole, "is_otb": otb, "is_rack": rack, "is_junction": box, "is_extended": f"({box} and ({m('t', EXTENDED)} or {m('lower(source_name)', NUMBERED_BOX)}))",
        "is_camera": f"(asset_type in ('cctv_fixed', 'cctv_camera', 'cctv_ptz', 'cctv_dome') or {m('t', CAMERAS)})", "is_power": f"(asset_type in ('pln_source', 'power_panel') or {m('t', POWER)})",
        "is_inline": f"(not {pole} and ({rack} or {m('t', INLINE)}))",
    }


def profile(like: str) -> str:
    """SQL of the profile that the words of a device suggest; null for other devices."""
    m = lambda c, p: f"{like}({c}, '{p}')"
    return (
        f"case when object_role <> 'device_node' then null when {m('t', 'server +rack|rack +server')} or {m('nm', RACK_NAMES)} then 'builtin:server_rack' when not {m('t', '(^| )(jb|junction)( |$)')} then null "
        f"when {m('t', 'poe|power over ethernet|switch|extender')} then 'builtin:extended_poe' when {m('t', EXTENDED)} or {m('lower(source_name)', NUMBERED_BOX)} then 'builtin:extended_passive' else 'builtin:main_jb' end"
    )


def family(column: str) -> str:
    """SQL of the family that a free family name stands for."""
    source = f"replace(replace(lower({column}), '_', '-'), ' ', '-')"
    any_ = lambda *w: " or ".join(f"contains({source}, '{x}')" for x in w)
    return (
        f"case when {source} = '' then 'unmapped' when {any_('fiber', 'fibre')} or {source} = 'fo' then 'fiber-optic' when {any_('utp', 'ethernet')} then 'utp' when {any_('power', 'listrik')} then 'power' when {any_('cctv', 'camera')} then 'cctv' "
        f"when {any_('lan')} then 'lan' when {any_('peripheral', 'printer', 'access-point')} then 'peripheral' when {any_('infra', 'switch', 'server', 'router', 'core', 'otb')} then 'infrastructure' else 'unmapped' end"
    )


def domain(family_: str, text: str, like: str) -> str:
    """SQL of the service a line or device carries: power by its words, data by its family."""
    return f"case when {like}({text}, '{POWER_LINES}') then 'power' when {family_} in ('cctv', 'lan', 'fiber_optic') then 'data' else 'unknown' end"


def fit(like: str) -> str:
    """SQL of how well a line (path_site, path_family, path_domain) may end at a device (site_id, network_family, node_domain and the tests as columns), 0 for not at all."""
    m = lambda c, p: f"{like}({c}, '{p}')"
    known = " or ".join(f"(path_family = '{f}' and {m('t', p)})" for f, p in ENDS_OF.items())
    return (
        "case when path_site <> site_id or is_pole then 0.0D when path_domain <> 'unknown' and path_domain = node_domain and path_family = network_family then 1.0D "
        "when path_domain <> 'unknown' and path_domain = node_domain and (is_junction or (path_domain = 'data' and is_rack)) then 0.95D "
        f"when (network_family = 'infrastructure' and ({known})) or (is_rack and path_domain = 'data') or (path_family = 'lan' and network_family = 'cctv' and {m('t', LAN_AT_CCTV)}) "
        f"or (path_family = 'fiber_optic' and network_family = 'cctv' and {m('t', FIBER_AT_CCTV)}) then 0.9D else 0.0D end"
    )
