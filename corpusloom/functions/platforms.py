"""Domain resolution: hosts of publishing platforms and where their pages name the publisher."""

from __future__ import annotations

# Host suffix, pattern of the entity in the address, element that names it in the page, further settings.
PLATFORMS: tuple[tuple[str, str | None, str | None, dict], ...] = (
    ('500px.com', None, 'ldjson_author', {}),
    ('academia.edu', r'([a-z0-9\-_]*\.?academia\.edu/(?!(?:search)|(?:Documents)|(?:login)|(?:signup)|(?:about)|(?:hiring))[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('agoravox.fr', r'(agoravox\.fr/auteur/[\w%-]+)', 'ldjson_author', {}),
    ('agoravox.tv', r'(agoravox\.tv/auteur/[\w%-]+)', 'ldjson_author', {}),
    ('amazon.fr', None, 'canonical', {}),
    ('ameblo.jp', r'(ameblo\.jp/(?!(?:search)|(?:hashtag)|(?:login))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('anchor.fm', r'(anchor\.fm/(?!(?:switch)|(?:dashboard))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('answers.com', None, 'ldjson_publisher', {}),
    ('artstation.com', r'(artstation\.com/(?!(?:artwork|search|marketplace|jobs|blogs|learning|prints|channels|contests|guides|podcast|about|terms|privacy)(?:[/.?]|$))[a-zA-Z0-9%_-]+)', 'ldjson_author', {}),
    ('ask.com', None, 'ldjson_publisher', {}),
    ('bandcamp.com', None, None, {}),
    ('behance.net', r'(behance\.net/(?!(?:gallery|galleries|search|assets|joblist|for_you|live|blog|hire|jobs|collection|discover|about)(?:[/.?]|$))[a-zA-Z0-9%_-]+)', 'ldjson_author', {}),
    ('bilibili.com', None, 'ldjson_author', {}),
    ('bitbucket.org', r'(bitbucket\.org/(?!(?:product)|(?:account)|(?:dashboard)|(?:search))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('bitchute.com', r'(bitchute\.com/channel/[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('blog4ever.com', None, None, {}),
    ('blogs.mediapart.fr', r'blogs\.mediapart\.fr/(?:blog/)?(?!(?:edition|sitemap)(?:[/.?]|$))([a-zA-Z0-9%._-]+)', 'rel_author', {'prefix': 'blogs.mediapart.fr/'}),
    ('blogspot.com', None, None, {}),
    ('bondyblog.fr', None, 'ldjson_author', {}),
    ('brighteon.com', r'(brighteon\.com/channels/[a-zA-Z0-9%_-]+)', 'ldjson_author', {}),
    ('bsky.app', r'([a-z0-9\-_]*\.?bsky\.app/profile/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('calameo.com', None, 'ldjson_author', {}),
    ('canalblog.com', None, None, {}),
    ('change.org', r'(change\.org/p/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('dailymotion.com', r'([a-z0-9\-_]+\.dailymotion\.com/(?!(?:video)|(?:search)|(?:topic)|(?:explore)|(?:pageitem)(?:[/?]|$)|(?:embed)(?:[/?]|$)|(?:player)(?:[/?]|$))[a-zA-Z0-9%\.\-_]+)/?\??', 'dailymotion_channel', {}),
    ('dev.to', r'(dev\.to/(?!(?:search)|(?:tags)|(?:top)|(?:latest)|(?:enter)|(?:about)|(?:contact)|(?:privacy)|(?:terms)|(?:t/)|(?:pod)|(?:videos))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('deviantart.com', r'(deviantart\.com/(?!(?:users|search|tag|topic|daily-deviations|shop|forum|groups|join|settings|notifications|watch|about|core-membership|print|developers|team)(?:[/.?]|$))[a-zA-Z0-9%_-]+)', 'ldjson_author', {}),
    ('diigo.com', r'(diigo\.com/user/[a-zA-Z0-9%_.-]+)', 'canonical', {}),
    ('docdroid.net', None, 'ldjson_publisher', {}),
    ('dribbble.com', r'(dribbble\.com/(?!(?:shots|search|designers|jobs|tags|about|stories|resources|teams|colors|following|signup|session|pro|integrations|shop|blog|pricing)(?:[/.?]|$))[a-zA-Z0-9%_-]+)', 'ldjson_author', {}),
    ('e-monsite.com', None, None, {}),
    ('ehow.com', None, 'ldjson_publisher', {}),
    ('eklablog.com', None, None, {}),
    ('eklablog.fr', None, None, {}),
    ('etsy.com', r'(etsy\.com/(?:shop|people)/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('eventbrite.com', r'(eventbrite\.com/o/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('eventbrite.fr', r'(eventbrite\.fr/o/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('ezinearticles.com', None, 'ldjson_author', {}),
    ('facebook.com', r'([a-z0-9\-_]+\.facebook\.com/(?:groups/[a-zA-Z0-9%\.\-_]+|pages/[^?#]*[^?#/]|(?!(?:notes)|(?:share)|(?:sharer)|(?:login)|(?:help)|(?:watch)|(?:events)|(?:groups)|(?:marketplace)|(?:gaming)|(?:stories)|(?:reel)|(?:wui)|(?:[a-zA-Z0-9%_\-]+\.php)(?:[/?]|$)|(?:dialog)(?:[/?]|$)|(?:plugins)(?:[/?]|$)|(?:pages)(?:[/?]|$))[a-zA-Z0-9%\.\-_]+))/?\??', 'og_url', {'alias': 'facebook.com', 'lower': True}),
    ('fandom.com', r'([a-z0-9\-_]+\.fandom\.com)', 'canonical', {}),
    ('fb.com', None, 'og_url', {}),
    ('feedly.com', None, 'canonical', {}),
    ('fextralife.com', None, None, {}),
    ('figshare.com', None, 'dc_creator', {}),
    ('flickr.com', r'(flickr\.com/photos/(?!(?:tags|search|groups|explore|map|favorites)(?:[/.?]|$))[a-zA-Z0-9%\.\-_@]+)', 'canonical', {}),
    ('flipboard.com', r'(flipboard\.com/@[\w%.-]+)', 'canonical', {}),
    ('forumactif.com', None, None, {}),
    ('forumactif.org', None, None, {}),
    ('fr.calameo.com', None, 'ldjson_author', {}),
    ('fr.quora.com', None, 'canonical', {}),
    ('fr.slideshare.net', None, 'ldjson_author', {}),
    ('fr.wikihow.com', None, 'ldjson_publisher', {}),
    ('gamepedia.com', None, None, {}),
    ('getpocket.com', None, 'canonical', {}),
    ('ghost.io', None, None, {}),
    ('github.com', r'(github\.com/(?!(?:search)|(?:explore)|(?:trending)|(?:login)|(?:join)|(?:settings)|(?:notifications)|(?:marketplace)|(?:sponsors)|(?:features)|(?:pricing)|(?:about)|(?:topics)|(?:collections)|(?:events)|(?:orgs))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('gitlab.com', r'(gitlab\.com/(?!(?:explore)|(?:search)|(?:help)|(?:users/sign_in)|(?:dashboard))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('gofundme.com', r'(gofundme\.com/f/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('gumroad.com', None, None, {}),
    ('hardware.fr', None, 'canonical', {}),
    ('hautetfort.com', None, None, {}),
    ('hubpages.com', r'(hubpages\.com/@[^/?#]+)', 'ldjson_author', {}),
    ('imgur.com', None, 'ldjson_author', {}),
    ('instagram.com', r'([a-z0-9\-_]+\.instagram\.com/(?!(?:explore)|(?:accounts)|(?:about)|(?:legal)|(?:developer)|(?:p/)|(?:reel/)|(?:stories/))[a-zA-Z0-9%\.\-_]+)/?\??', 'ldjson_author', {'alias': 'instagram.com', 'lower': True}),
    ('instructables.com', r'(instructables\.com/member/[^/?#]+)', 'ldjson_author', {}),
    ('issuu.com', r'(issuu\.com/(?!(?:search|explore|signin|signup|login|publish|features|pricing|about|home|stores|call-for-content|legal|careers|press|plans|help|blog|oembed)(?:[/.?]|$))[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('jimdo.com', None, None, {}),
    ('jimdofree.com', None, None, {}),
    ('ko-fi.com', r'(ko-fi\.com/(?!(?:explore)|(?:about)|(?:gold)|(?:manage))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('leboncoin.fr', None, 'canonical', {}),
    ('linkedin.com', r'([a-z0-9\-_]+\.linkedin\.com/(?:in|company)/[a-zA-Z0-9%\.\-_]+)/?\??', 'ldjson_author', {}),
    ('linktr.ee', r'(linktr\.ee/(?!(?:admin)|(?:s/))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('list.ly', None, 'canonical', {}),
    ('livejournal.com', None, None, {}),
    ('medium.com', r'([a-z0-9\-_]*\.?medium\.com/(?!(?:search)|(?:explore)|(?:topics)|(?:me/)|(?:plans)|(?:about)|(?:creators)|(?:tag/)|(?:membership)|(?:p/))[a-zA-Z0-9%@\.\-_]+)', 'canonical', {}),
    ('meetup.com', r'(meetup\.com/(?!(?:find)|(?:topics)|(?:cities)|(?:login)|(?:register)|(?:about)|(?:help))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('mesopinions.com', None, 'canonical', {}),
    ('miraheze.org', None, None, {}),
    ('mixcloud.com', r'(mixcloud\.com/(?!(?:discover|search|upload|live|categories|browse|settings|about|help|jobs|tag|popular|new|terms|privacy|select)(?:[/.?]|$))[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('netvibes.com', r'(netvibes\.com/(?!(?:en|fr|de|es|it|pt|ru|ja|zh|nl|privacypolicy|subscribe|tour|api|apps|basic|download|signin|signup)(?:[/.?]|$))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('news.google.com', None, 'canonical', {}),
    ('note.com', r'(note\.com/(?!(?:search)|(?:explore)|(?:ranking)|(?:topics)|(?:hashtag)|(?:login)|(?:signup))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('odysee.com', r'(odysee\.com/@[a-zA-Z0-9%\.\-_:]+)', 'canonical', {}),
    ('ok.ru', None, 'og_url', {}),
    ('open.spotify.com', r'(open\.spotify\.com/(?:show|artist)/[a-zA-Z0-9%]+)', 'canonical', {}),
    ('over-blog.com', None, None, {}),
    ('padlet.com', r'(padlet\.com/(?!(?:dashboard|gallery|auth|login|signup|about|features|pricing|search|home|my|settings|help|blog|apps|join|browse|tags|explore)(?:[/.?]|$))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('pagesperso-orange.fr', r'(pagesperso-orange\.fr/~[\w%.-]+)', 'canonical', {}),
    ('paper.li', r'(paper\.li/(?!(?:edition|tag|topic|search|about|faq|pricing|login|signup|home)(?:[/.?]|$))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('patreon.com', r'(patreon\.com/(?!(?:search)|(?:explore)|(?:login)|(?:signup)|(?:about)|(?:policy)|(?:careers)|(?:c/))[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('pearltrees.com', r'(pearltrees\.com/(?!(?:about|faq|help|pricing|business|education|download|login|signup|search|s)(?:[/.?]|$))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('pinterest.com', r'([a-z0-9\-_]+\.pinterest\.com/(?!(?:pin)|(?:search)|(?:ideas)|(?:today)|(?:business))[a-zA-Z0-9%\.\-_]+)/?\??', 'og_url', {}),
    ('pinterest.fr', r'([a-z0-9\-_]+\.pinterest\.fr/(?!(?:pin)|(?:search)|(?:ideas))[a-zA-Z0-9%\.\-_]+)/?\??', 'og_url', {}),
    ('prezi.com', None, 'ldjson_author', {}),
    ('proboards.com', None, None, {}),
    ('quora.com', None, 'canonical', {}),
    ('reddit.com', r'([a-z0-9\-_]*\.?reddit\.com/r/(?!(?:all)|(?:popular)|(?:home))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('researchgate.net', r'(researchgate\.net/profile/[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('rumble.com', r'(rumble\.com/(?:c|user)/[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('scoop.it', r'(scoop\.it/u/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('scribd.com', None, 'ldjson_author', {}),
    ('senscritique.com', None, 'canonical', {}),
    ('skyrock.com', None, None, {}),
    ('slideshare.net', r'([a-z0-9\-_]+\.slideshare\.net/(?!(?:search)|(?:explore)|(?:featured))[a-zA-Z0-9%\.\-_]+)/?\??', 'ldjson_author', {}),
    ('snapchat.com', r'([a-z0-9\-_]*\.?snapchat\.com/add/[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('soundcloud.com', r'(soundcloud\.com/(?!(?:search)|(?:discover)|(?:stream)|(?:upload)|(?:you/)|(?:charts)|(?:tags/)|(?:stations)|(?:login)|(?:pages))[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('speakerdeck.com', r'(speakerdeck\.com/(?!(?:p|explore|search|about|terms|privacy|signin|signup|features|pricing|help|oembed|category)(?:[/.?]|$))[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('squarespace.com', None, None, {}),
    ('ssrn.com', None, 'citation_author', {}),
    ('stackexchange.com', None, 'canonical', {}),
    ('stackoverflow.com', None, 'canonical', {}),
    ('substack.com', None, None, {}),
    ('t.me', r'(t\.me/(?!(?:addstickers)|(?:joinchat)|(?:addtheme)|(?:share)|(?:login)|(?:auth)|(?:dl))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('telegram.me', r'(telegram\.me/(?!(?:addstickers)|(?:joinchat)|(?:share))[a-zA-Z0-9%\.\-_]+)', 'canonical', {}),
    ('threads.net', r'([a-z0-9\-_]*\.?threads\.net/@[a-zA-Z0-9%\.\-_]+)', 'canonical', {'alias': 'threads.net', 'lower': True}),
    ('tiktok.com', r'([a-z0-9\-_]*\.?tiktok\.com/@[a-zA-Z0-9%\.\-_]+)', 'canonical', {'alias': 'tiktok.com', 'lower': True}),
    ('trello.com', None, 'canonical', {}),
    ('tripadvisor.fr', None, 'canonical', {}),
    ('trustpilot.com', r'trustpilot\.com/review/([\w%.-]+)', 'canonical', {}),
    ('tumblr.com', None, None, {}),
    ('twitch.tv', r'([a-z0-9\-_]*\.?twitch\.tv/(?!(?:directory)|(?:search)|(?:downloads)|(?:jobs)|(?:turbo)|(?:settings)|(?:subscriptions)|(?:p/))[a-zA-Z0-9%\.\-_]+)', 'ldjson_author', {}),
    ('twitter.com', r'([a-z0-9\-_]*\.?twitter\.com/(?!(?:hashtag)|(?:search)|(?:home)|(?:share)|(?:explore)|(?:login)|(?:i/)|(?:settings)|(?:notifications)|(?:messages)|(?:compose)|(?:tos)|(?:privacy)|(?:intent)|(?:web))[a-zA-Z0-9%\.\-_]+)', 'canonical', {'alias': 'x.com', 'lower': True}),
    ('typepad.com', None, None, {}),
    ('vimeo.com', r'([a-z0-9\-_]+\.vimeo\.com/(?!(?:search)|(?:categories)|(?:watch)|(?:features)|(?:about))[a-zA-Z0-9%\.\-_]+)/?\??', 'og_url', {}),
    ('vk.com', r'(vk\.com/(?!(?:feed)|(?:im)|(?:friends)|(?:search)|(?:login)|(?:join)|(?:about)|(?:away\.php)|(?:share\.php))[a-zA-Z0-9%\.\-_]+)', 'og_url', {}),
    ('wakelet.com', None, 'canonical', {}),
    ('wattpad.com', None, 'ldjson_author', {}),
    ('webnode.fr', None, None, {}),
    ('weebly.com', None, None, {}),
    ('weibo.com', None, 'canonical', {}),
    ('wikia.com', None, None, {}),
    ('wikibooks.org', None, 'canonical', {}),
    ('wikidot.com', None, None, {}),
    ('wikihow.com', None, 'ldjson_publisher', {}),
    ('wikiversity.org', None, 'canonical', {}),
    ('wixsite.com', None, None, {}),
    ('wordpress.com', None, None, {}),
    ('x.com', r'([a-z0-9\-_]*\.?x\.com/(?!(?:hashtag)|(?:search)|(?:home)|(?:share)|(?:explore)|(?:login)|(?:i/)|(?:settings)|(?:notifications)|(?:messages)|(?:compose)|(?:tos)|(?:privacy)|(?:intent)|(?:web))[a-zA-Z0-9%\.\-_]+)', 'canonical', {'alias': 'x.com', 'lower': True}),
    ('xooit.com', None, None, {}),
    ('xooit.org', None, None, {}),
    ('yelp.fr', r'yelp\.fr/biz/([\w%-]+)', 'canonical', {}),
    ('youtu.be', None, 'ldjson_author', {}),
    ('youtube.com', r'([a-z0-9\-_]*\.?youtube\.com/(?:@[a-zA-Z0-9%\.\-_]+|(?:channel|c|user)/[a-zA-Z0-9%\.\-_]+))', 'itemprop_author', {}),
    ('zenodo.org', None, 'ldjson_author', {}),
)
